"""The layout of token files: encodings, row groups, page indexes, and how little a selective read takes."""

import glob

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from framesift.llm import token_files


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "ids")
    docs = spark.range(4000).selectExpr("id * 3 AS doc_id", "array_join(transform(sequence(1, 300), x -> conv(abs(hash(id, x)) % 40000, 10, 36)), ' ') AS text")
    settings = {"parquet.block.size": str(256 << 10), "parquet.page.size": str(16 << 10)}
    old = dict(token_files.WRITER)
    token_files.WRITER.update(settings)
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), file_bytes=1 << 20)
    token_files.WRITER.update(old)
    return path


def test_layout(written):
    files, groups = sorted(glob.glob(f"{written}/*.parquet")), 0
    assert len(files) > 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema.split(".")[0]: c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))}
            assert meta.row_group(g).total_byte_size < 2 << 20
            assert "RLE_DICTIONARY" in columns["ids"].encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["start_in_part"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert groups > 2 * len(files)


def test_selective_read(spark, written):
    rows = token_files.read_range(spark, written, 3000, 3030)
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(3000, 3031, 3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3000)" in plan and "LessThanOrEqual(doc_id,3030)" in plan
    counts = token_files.read_range(spark, written, 0, 100, ("doc_id", "n_tokens"))
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    # row groups whose statistics admit the range
    held = total = 0
    for f in glob.glob(f"{written}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            total += 1
            held += s.min <= 3030 and s.max >= 3000
    assert held <= 2 < total / 5


def test_words_of_plain_letters_are_looked_up_in_the_model():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["plain words, of (letters) only... and plain's \u00e9t\u00e9! \u017fo \u0130t", "Words.\n\nwords... x1abc, ,,, don't-do <|endoftext|> \u00df\u00ff; \u00aa\u00ba", "", " a  b ", "zqxjk" * 30 + " " + "zqxjk" * 10 + "!!"]
    words = token_files.WordEncoder(path)
    assert words.encode_batch(texts) == token_files.TextEncoder(path).encode_batch(texts)
    words.of_letters = None
    assert words.encode_batch(["made-up qwzzy, words! (qwzzx) vrrt"]) == token_files.TextEncoder(path).encode_batch(["made-up qwzzy, words! (qwzzx) vrrt"])


def test_the_cache_is_asked_once_for_each_word_of_a_portion():
    class Cache(dict):
        asked = 0

        def get(self, word):
            self.asked += 1
            return super().get(word)

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = token_files.WordEncoder(path), token_files.TextEncoder(path)
    words.words = Cache()
    long = "\u00e9t\u00e9" * 40
    texts = ["the same, same words of (one) portion\n" * 500, "", f"{long} same {long}! x\0y " * 3, " ", "portion\tof same, " * 500 + "\u017fame"]
    for _ in range(2):  # what is cached must not matter
        assert words.encode_batch(texts) == library.encode_batch(texts)
    assert words.words.asked < 100
    assert words.encode_batch([]) == [] and words.encode_batch([""]) == [b""]
