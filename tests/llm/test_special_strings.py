"""Special strings in any case against the library, and files of other kinds."""

import json
import random

import public_tokenizers
from framesift.llm import token_files
from tokenizers import Tokenizer

TEXTS = [
    "<|ENDOFTEXT|>", "<|EndOfText|> and <|endoftext|>", "Ab<|StartOfText|>Cd <|startoftext|>", "É <|ENDOFTEXT|>\nUPPER Words", "<|endoftext|> Plain", "<|endoftext|",
    "<|endoftext|><|ENDOFTEXT|>x", "ſ <|ENDOFTEXT|>",
]
_rng = random.Random(9)


def _any_case(text):
    return "".join(_rng.choice((c, c.upper())) for c in text)


for _ in range(400):
    special = _rng.choice(["<|endoftext|>", "<|startoftext|>"])
    special = _rng.choice([special, special.upper(), _any_case(special), special[:-1]])
    TEXTS.append("".join(_rng.choice(["Word", " ", special, "it's", "'S", "\n", "é", "É", "İ", "x1", "!?", "<|", "|>", " the "]) for _ in range(_rng.randint(1, 9))))


def ids_of(packed):
    return [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in packed]


def test_special_strings():
    name = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(name), token_files.encoder(name)
    assert isinstance(own, token_files.WordEncoder)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for texts, ids in [(TEXTS, wanted), (TEXTS[::-1], wanted[::-1])]:  # what is cached must not matter
        assert ids_of(own.encode_batch(texts)) == ids


def test_other_files_are_given_whole_texts(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"]["normalizers"] = file["normalizer"]["normalizers"][:2]  # case matters
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    own, library = token_files.encoder(path), Tokenizer.from_file(path)
    assert isinstance(own, token_files.TextEncoder) and isinstance(token_files.encoder(public_tokenizers.path("byte_bpe_50k.json")), token_files.TextEncoder)
    assert ids_of(own.encode_batch(TEXTS)) == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
