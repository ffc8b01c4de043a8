"""Quality rules as a bitmask ledger.

Every rule is judged once per document; the ledger keeps the measurements and one bit for each rule
that failed. A policy is a versioned mask over those bits, so another policy or an ablation ("what would
be kept without rule X?") is a bitwise aggregate over the ledger and reads no text again.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.common import shared_dir

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capital_words")

#: Rule name -> failed when; the position is the rule's bit. Whole numbers only, so both sides compare exactly.
RULES: dict[str, Callable[[], Column]] = {
    "too_few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "duplicate_lines": lambda: (F.col("n_lines") >= 10) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    "letters": lambda: 10 * F.col("n_letter_words") < 8 * F.col("n_words"),
    "capitals": lambda: 10 * F.col("n_capital_words") > 3 * F.col("n_words"),
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE_MASK = BITS["too_few_words"] | BITS["repeated_words"]
#: Versioned policies: the bits that reject a document.
POLICIES = {1: BASE_MASK, 2: BASE_MASK | BITS["symbols"] | BITS["duplicate_lines"], 3: sum(BITS.values())}
#: Entries of the cache of a Python worker, and bytes of the longest word in it.
KNOWN_WORDS, KNOWN_LENGTH = 200_000, 64
CURRENT_POLICY = 3


class _Signs(dict):
    """Word to 1 if it holds a letter, plus 2**32 if it is in capitals: two of A to Z or more, and none of a to z."""

    def __missing__(self, word: bytes) -> int:
        capitals = sum(65 <= c <= 90 for c in word) > 1 and not any(97 <= c <= 122 for c in word)
        value = int(any(map(str.isalpha, word.decode()))) + (capitals << 32)
        if len(word) <= KNOWN_LENGTH:
            if len(self) > KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


_signs = _Signs()


def _forget() -> None:
    """Empty the cache: the worker may serve other stages."""
    _signs.clear()


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more in ``words``."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    n, end = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of the ledger's columns."""
    words = text.encode().split()  # bytes.split() takes exactly \x20 and \x09-\x0D as space
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    capitals, letters = divmod(sum(map(_signs.__getitem__, words)), 1 << 32)
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        letters,
        capitals,
    )


def _measurer(at: int, keep: int):
    """Batches of documents to batches of their first ``keep`` columns and the measurements of column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column(at).to_pylist()]
            measures = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(_MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *measures], [*batch.schema.names[:keep], *_MEASURES])
        _forget()

    return run


def ledger(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: the columns ``keep``, the measurements and ``fail_bits``.

    A null or empty text has no words and fails ``too_few_words``. Repeated rows and repeated or null ids are
    judged row by row; an empty table gives an empty ledger. Columns outside ``keep`` are ignored. A kept
    column with the name of a measurement raises, as it would be ambiguous; ``keep_documents`` has no such limit.
    """
    taken = sorted({*_MEASURES, "fail_bits"}.intersection(keep))
    if taken:
        raise ValueError(f"columns with the names of measurements: {taken}")
    return _ledger(docs, keep, text).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def _ledger(docs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """The ledger with the kept columns as k0, k1, ..."""
    names = [*keep, *([] if text in keep else [text])]
    source = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(names)))
    schema = T.StructType([*source.schema.fields[: len(keep)], *(T.StructField(m, T.LongType()) for m in _MEASURES)])
    measured = source.mapInArrow(_measurer(names.index(text), len(keep)), schema)
    bits = sum((F.when(failed(), F.lit(BITS[name])).otherwise(F.lit(0)) for name, failed in RULES.items()), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def passes(version: int = CURRENT_POLICY) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0


def ablation(led: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it."""
    mask = POLICIES[version]
    per_bits = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BITS.items() if bit & mask]
    each = per_bits.select("bits", "n", F.inline(F.array(*rules)))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(F.lit(0))).alias("n_kept_without"),
    )


def keep_documents(docs: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns, whatever their names."""
    columns = docs.columns
    kept = _ledger(docs, columns, "text").where(passes(version))
    return kept.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)))


def verdicts(led: DataFrame) -> DataFrame:
    """A ledger with the verdict of each version of the policy; ``kept`` is the current one's."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return led.select("doc_id", *_MEASURES, base.alias("base_failed"), passes().alias("kept"), "fail_bits", *(passes(v).alias(f"kept_v{v}") for v in POLICIES))


def write_ledger(docs: DataFrame, path: str) -> None:
    """The ledger of ``docs`` as Parquet: what versions of the policy and ablations read, and the texts no more."""
    ledger(docs).write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger that was written."""
    return spark.read.parquet(path)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, the failure bits and all verdicts of each row of ``docs``, in one pass over the texts."""
    return verdicts(ledger(docs))


def ablation_query(docs: DataFrame) -> DataFrame:
    """What each rule does under every version of the policy: one ledger is written, and all versions read it."""
    path = f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    write_ledger(docs, path)
    led = read_ledger(docs.sparkSession, path)
    return reduce(DataFrame.unionByName, (ablation(led, v).withColumn("version", F.lit(v)) for v in POLICIES))
