"""Token operators against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from framesift.llm import byte_bpe, token_count, token_files
from tokenizers import Tokenizer

TEXTS = [
    None, "", " ", "a", "Hello, world!  Two  spaces", "it's we'll DON'T 'S x's", "line\nline\r\n\ttab \x0b", "éÉ ÀÖ ſs İi ΣΑΣ ß", "12 345 1e5 3.14,15!? ...",
    "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テスト 한국어 🙂🙂👩‍👩‍👧", "é ö 한", " nb sp　", "a" * 3000, "ab " * 2000 + "z" * 500, "!!!???", "\x00\x01\x7f", "▁ ▁▁x", "trailing space ",
]
_rng = random.Random(5)
_ALPHABET = "aabcdeEThnsr.,!?' \n\t019-éüßÀΣİſ日🙂́▁"
TEXTS += ["".join(_rng.choice(_ALPHABET) for _ in range(_rng.randint(1, 120))) for _ in range(400)]


@pytest.fixture
def docs(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2), (None, "no id", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def test_byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    found = byte_bpe.query(docs, path, public_tokenizers.PATTERN).collect()
    assert len(found) == docs.count()
    for r in found:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), text
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decoded(byte_bpe.encoded(docs, path, public_tokenizers.PATTERN, ["doc_id", "text"]), path, public_tokenizers.PATTERN).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    assert byte_bpe.query(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_token_count(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = token_count.counted(docs, path, 100).collect()
    assert len(found) == docs.count()
    for r in found:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100), text


@pytest.mark.parametrize("file_bytes", [1 << 20, 2000])
def test_token_files(spark, docs, tmp_path, file_bytes):
    name = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(name)
    token_files.write(docs, str(tmp_path / "ids"), name, file_bytes=file_bytes)
    files = token_files.read(spark, str(tmp_path / "ids"))
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(files).collect())
    order = [None, *sorted([*range(len(TEXTS)), 3])]
    assert [r[1] for r in found] == order
    start = 0
    for r in found:
        ids = [*library.encode("no id" if r[1] is None else TEXTS[r[1]] or "", add_special_tokens=False).ids, 1]
        assert r[0] == start and r[2] == len(ids) and r[3] == zlib.crc32(np.array(ids, "<u4").tobytes()), r
        start += len(ids)
    assert token_files.query(docs.limit(0), name).count() == 0
