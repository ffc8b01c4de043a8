"""Token ids as Parquet list columns.

One row a document, in ascending id order over all files. Ids are dictionary-encoded, so one takes 16 bits or
fewer; the other integers are delta-encoded; row groups are small and the writer adds page indexes, so a
reader can fetch the ids of a few documents, or the counts of all of them, without touching the rest.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, compress
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.llm.common import shared_dir, text_of, total_bytes

#: Bytes of text that go to one file, and the writer's settings.
FILE_BYTES = 64 << 20
WRITER = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "compression": "zstd",
}
#: Words and stems that a Python worker keeps at most: short ones, about 200 bytes each; and characters of text that it splits at once.
KNOWN_WORDS, KNOWN_STEMS, PORTION = 900_000, 300_000, 2 << 20
#: Letters whose lower case Python and the library may see differently, lower-case letters, and marks that may stand behind them.
SPECIAL_CASE = re.compile("[^\0-\u017f]|[\u0130\u017f]")
LETTERS, MARKS = string.ascii_lowercase + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100), 0x153])), string.punctuation
#: The normaliser and the pattern of words of the kind of file whose words can be looked up one by one.
WORDWISE = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def wordwise(path: str) -> bool:
    """Whether a file is of the kind in which words between spaces don't affect each other and case doesn't matter."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    parts = (file["normalizer"] or {}).get("normalizers"), (file["pre_tokenizer"] or {}).get("pretokenizers")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in file["added_tokens"])
    return parts == WORDWISE and plain and not file["post_processor"]


def objects(column: pa.Array) -> list:
    """The values of a column without nulls; many times faster than ``to_pylist`` where they are short."""
    return column.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """The library's encoder, given whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native (little-endian) 32-bit integers."""
        return [np.array(x.ids, "<i4").tobytes() for k in range(0, len(texts), 64) for x in self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)]


class WordEncoder:
    """The library's encoder, asked once for each word, for files that are ``wordwise``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: For lower-case words of letters, which the file's normaliser and pattern leave as they are: what the library
        #: does with a word once it is cut out and its bytes are written as characters.
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in LETTERS if not c.isascii()}
        #: Strings that the library takes as one token, before it lowers the case.
        self.specials = [(t.content, t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _look_up(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids, as the library gives them."""
        for k in range(0, len(words), 10_000):
            some = words[k : k + 10_000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                yield word, np.array(found.ids, "<i4").tobytes()

    def _look_up_stems(self, stems: list[str]) -> Iterator[tuple[str, bytes]]:
        """The same for words of letters only."""
        tokens = self.model.tokenize
        written = "\n".join(stems).translate(self.written).split("\n") if stems else []
        return ((stem, array("i", [t.id for t in tokens(x)]).tobytes()) for stem, x in zip(stems, written))

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of new short words, which are put in the cache.

        The file's pattern never joins letters with what isn't one, so lower-case letters before marks are looked up
        as the letters and the marks; any other word is looked up whole.
        """
        stems = self.stems
        if len(stems) > KNOWN_STEMS:
            stems.clear()
        stems[""] = b""
        unmarked = pc.ascii_rtrim(pa.array(new, pa.string()), MARKS)
        of_letters = pc.equal(pc.utf8_ltrim(unmarked, LETTERS), "")
        is_cut, heads = objects(of_letters), objects(unmarked.filter(of_letters))
        cut = list(compress(new, is_cut))
        tails = [word[len(head) :] for word, head in zip(cut, heads)]
        unknown = set(heads).difference(stems)
        if any(s.isalpha() for s, _ in self.specials):
            stems.update(self._look_up(list(unknown)))
        else:
            ascii_only = [stem for stem in unknown if stem.isascii()]
            stems.update(self._look_up_stems(ascii_only))
            stems.update(self._look_up_stems(list(unknown.difference(ascii_only))))
        stems.update(self._look_up(list(set(tails).difference(stems))))
        learned = dict(zip(cut, map(add, map(stems.__getitem__, heads), map(stems.__getitem__, tails))))
        learned.update(self._look_up([word for word, is_one in zip(new, is_cut) if not is_one]))
        self.words.update(learned)
        return learned

    def _lowered(self, text: str) -> str:
        """The text in lower case, so that fewer words are new; as it is where that could change its ids."""
        if not text.isascii() and SPECIAL_CASE.search(text):
            return text
        lower = text.lower()
        return text if any(s_lower in lower and lower.count(s) != text.count(s) for s, s_lower in self.specials) else lower

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native (little-endian) 32-bit integers."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > PORTION:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The same for one portion: Arrow cuts it into words and tells them apart, so the cache is asked once for each of them."""
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        parts = pc.split_pattern(pa.array([self._lowered(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        numbers = parts.values.dictionary_encode()
        distinct = objects(numbers.dictionary)
        known = list(map(self.words.get, distinct))
        new = [word for word, ids in zip(distinct, known) if ids is None]
        learned = self._learn([w for w in new if len(w) < 100])
        learned.update(self._look_up([w for w in new if len(w) >= 100]))
        found = pa.array([learned[word] if ids is None else ids for word, ids in zip(distinct, known)], pa.large_binary())
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, found.take(numbers.indices)), pa.scalar(b"", pa.large_binary())).to_pylist()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | TextEncoder:
    """One encoder for each worker and file: word by word where the file is of the kind that allows it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path) if wordwise(path) else TextEncoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all whole texts of ``docs`` (doc_id, text) below ``path``.

    A null text counts as empty; an empty one has the end id only. A null doc_id goes first. Rows with the same
    doc_id stand in the order of their texts; equal rows are each written. An empty table writes files without
    rows. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), text_of().alias("t"))
    files = max(1, -(-total_bytes(source, "t") // file_bytes))
    ordered = source.repartitionByRange(files, "doc_id", F.xxhash64("t")).sortWithinPartitions("doc_id", F.xxhash64("t"), "t")
    end = np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = encoder(tokenizer), 0
        for batch in batches:
            packed = [x + end for x in words.encode_batch(batch.column(1).to_pylist())]
            n = [len(x) // 4 for x in packed]
            offsets = [0, *accumulate(n)]
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            starts = pa.array([start + x for x in offsets[:-1]], pa.int64())
            start += offsets[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), starts, pa.array(n, pa.int32()), ids], ["doc_id", "start_in_part", "n_tokens", "ids"])

    rows = ordered.mapInArrow(run, "doc_id long, start_in_part long, n_tokens int, ids array<int>")
    rows.select("doc_id", F.spark_partition_id().alias("part"), "start_in_part", "n_tokens", "ids").write.options(**WRITER).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, without reading their schema from them."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_range(spark: SparkSession, path: str, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Some columns of the documents from ``first`` to ``last``. Files are in order of ids, so the reader skips all files, row groups and pages but those."""
    return read(spark, path).where(F.col("doc_id").between(first, last)).select(*columns)


def starts(files: DataFrame) -> DataFrame:
    """``part`` and ``base``, the ids in all parts before it; one row a file, whatever the number of documents."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def digests(files: DataFrame) -> DataFrame:
    """Each document's place in the sequence of all ids, and the checksum of its own, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            flat, cuts = ids.flatten().to_numpy().astype("<u4"), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())].tolist()
            sums = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sums], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens int, ids_crc32 long")
    placed = rows.join(starts(files), "part")
    return placed.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder and return what they hold."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/framesift-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return digests(read(spark, path))
