"""The pipeline against a plain version of its stages, and the keeping of clean documents."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from framesift.llm import byte_bpe
from test_near_copies import kept_of
from test_quality import plain as measured
from test_secrets import plain_candidates, plain_spans

SF = "/root/testdata/sf0.001"


def plain(docs, items):
    kept = [d for d in docs if judged(d["text"] or "")]
    groups = kept_of([(d["doc_id"], d["text"]) for d in kept])
    kept = [kept[min(g, key=lambda i: kept[i]["doc_id"])] for g in groups]
    wanted = [windows(i["text"] or "") for i in items]
    leaky = lambda t: any(w and len(w & t) >= 0.8 * len(w) for w in wanted)
    kept = [d for d in kept if not leaky(windows(d["text"]))]
    owners = {}
    for d in kept:
        for m in plain_candidates(d["text"], plain_spans(d["text"])):
            owners.setdefault(m[0], set()).add(d["source"])
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d in kept:
        base = plain_spans(d["text"])
        live = [m.span() for m in plain_candidates(d["text"], base) if len(owners[m[0]]) == 1]
        ids = library.encode_ordinary(without(d["text"], [(a, b) for a, _, b in base] + live))
        out.append((d["doc_id"], len(ids), np.array(ids, "<u4").tobytes()))
    return sorted(out)


def windows(text):
    """Runs of five words without marks and in lower case; a shorter text is one."""
    words = [w for w in (x.strip(" .,;:!?\"'()[]").lower() for x in text.split()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without(text, spans):
    """The text with each character that is in a span gone, and a placeholder for each run of overlapping spans."""
    runs = []
    for a, b in sorted(spans):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    for a, b in reversed(runs):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def judged(text):
    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letter_words, n_capital_words, base_failed = measured(text)
    return not (
        base_failed or 10 * n_symbols > n_words or (n_lines >= 10 and 10 * n_dup_lines > 3 * n_lines)
        or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_letter_words < 8 * n_words or 10 * n_capital_words > 3 * n_words
    )


def test_run(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    found = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert found == plain(docs, items)
    assert len(docs) / 2 < len(found) < len(docs)


def test_stages_keep_the_columns(spark):
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(80))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate([prose(), None, "", prose(), prose()])], "doc_id long, text string, lang string, source string, n_chars long, key string")
    docs = docs.union(docs.where("doc_id = 0"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"], name
        assert sorted(r["doc_id"] for r in docs.collect()) == ([0, 0, 3, 4] if name == "quality rules" else [0, 3, 4])
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stage_list():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_leaks", "secret_scan", "encode"]
