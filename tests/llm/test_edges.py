"""Empty tables, null ids and clashing names, for operators whose own tests have other things to do."""

import hashlib

import public_tokenizers
import pytest
from framesift.llm import byte_bpe, decontaminate, importance, near_copies, ppm, secrets, sharding, substrings, token_count, token_files

PIECES, RANKS, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
QUERIES = {
    "op1": lambda d: byte_bpe.query(d, RANKS, public_tokenizers.PATTERN),
    "op3": lambda d: token_count.counted(d, PIECES, 3),
    "op5": ppm.query,
    "op6": lambda d: token_files.query(d, WORDS),
    "op8": substrings.query,
    "op10": lambda d: secrets.query(d, verdicts=True),
    "op11": lambda d: importance.query(d, d.sparkSession.createDataFrame([("one two",), (None,)], "text string")),
    "op13": sharding.query,
    "near copies": near_copies.keep_one,
}
#: Names that the operators use within.
CLASHES = "n_tokens bigint, n_bytes bigint, rid bigint, t string, shard int, key string, hash string, place int, window bigint, fp bigint, ids array<int>, found int, start bigint, held_out boolean, word string, n bigint, node bigint, row_id bigint"


@pytest.mark.parametrize("name", QUERIES)
def test_edges(spark, name):
    """Clashing names change nothing, null ids and null texts get a row each, an empty table gives none."""
    rows = [(None, "one two three four five six", "s", "en"), (None, None, None, None), (None, "", "s", None), (3, "token=abcdef123", "s", "de"), (3, "token=abcdef123", "s", "de")]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    clashing = spark.createDataFrame([(*r, *[None] * 18) for r in rows], f"doc_id bigint, text string, source string, lang string, {CLASHES}")
    columns = QUERIES[name](plain).columns
    found = sorted((tuple(r) for r in QUERIES[name](plain).collect()), key=str)
    assert sorted((tuple(r) for r in QUERIES[name](clashing).select(*columns).collect()), key=str) == found
    assert len(found) == (3 if name == "near copies" else 5)
    assert QUERIES[name](clashing.limit(0)).count() == 0


def test_all_ids_null(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, passage), (None, f"{passage} more"), (None, "x")], "doc_id bigint, text string")
    found = sorted((r["n_words"], r["n_removed"]) for r in substrings.query(docs).collect())
    assert found in ([(1, 0), (30, 0), (31, 30)], [(1, 0), (30, 30), (31, 0)])  # the one with the lesser hash of its text stays
    assert hashlib.sha256(b"x").hexdigest() in {r["kept_sha256"] for r in substrings.query(docs).collect()}
    starts = sorted((r["start"], r["n_tokens"]) for r in token_files.query(docs, WORDS).collect())
    assert [s for s, _ in starts] == [0, starts[0][1], starts[0][1] + starts[1][1]]


def test_encoded_with_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, ids int, k0 string")
    with pytest.raises(ValueError, match="ids"):
        byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, ("doc_id", "ids"))
    row = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, ("k0", "doc_id")).first()
    assert (row["k0"], row["doc_id"], len(row["ids"])) == ("x", 1, 8)


def test_clean_rows_with_null_ids_and_repeats(spark):
    """Rows go by what they say, not by their ids: of those without one, only the leak; repeats all stay or all go."""
    item = "the quick brown fox jumps over the lazy dog near the river"
    rows = [(None, item, 1), (None, "a clean text without any of that in it", 2), (None, "a clean text without any of that in it", 2), (5, item, 3), (5, item, 3), (5, "clean, too, and under the same id", 4), (None, None, 5), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    items = spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string")
    assert sorted(r["key"] for r in decontaminate.keep_clean(docs, items).collect()) == [2, 2, 4, 5, 5]
