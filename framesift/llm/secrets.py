"""Secret scans with corpus-wide ownership frequency.

The scan finds assignments, access keys and long hex strings by pattern, and other tokens that look random as
candidates. The values of both are hashed and counted by the distinct repositories and owners that hold them: one
that several owners hold, or very many repositories of one owner, is a widely copied example; one that is in few
repositories of a single owner is a live-looking credential; of the candidates these are added to the spans. Nothing but hashes, positions and owners leaves the scan.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.common import join_facts, saved, text_of

KINDS = ("assign", "access", "hex", "live")
#: What a verdict is on: the value of a base span, or a candidate.
VALUES, CANDIDATE = ("assign", "access", "hex", "token"), 3
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Upper- and lower-case ASCII letters only are alike, hence re.ASCII.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = "[SECRET]"
#: Parts of paths, slugs and names in code: words, and short numbers.
WORD = re.compile(r"(?:[A-Z]?[a-z]+)+|[A-Z]{2,}|[0-9]{1,4}")
#: A candidate has at least so many bits of entropy a character; one with more owners or repositories than these is an example.
ENTROPY, OWNERS, REPOSITORIES = 3.0, 1, 10

_FOUND = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("kind", "integer").add("hash", "string"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order; positions in code points, the end exclusive."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def looks_random(token: str) -> bool:
    """True for letters and digits mixed as in a generated credential; a path or slug, half of words or more, is none."""
    if not (any(map(str.isdigit, token)) and any(map(str.isalpha, token))):
        return False
    parts = re.split("[/_=+-]+", token)
    if len(parts) > 1 and 2 * sum(len(x) for x in parts if WORD.fullmatch(x)) >= sum(map(len, parts)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= ENTROPY


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, hash) of tokens that look random and overlap no base span."""
    found = []
    for m in TOKEN.finditer(text):
        if looks_random(m[0]) and not any(start < m.end() and m.start() < end for start, _, end in base):
            found.append((m.start(), m.end(), hashlib.sha256(m[0].encode()).hexdigest()))
    return found


def base_values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, hash of the value) of the base spans; an assignment's value is what is assigned, without a full stop behind it."""
    found = []
    for start, kind, end in base:
        value = text[start:end]
        if kind == 0:
            said = ASSIGN.match(text, start)[2]
            value = said.rstrip(".") or said
        found.append((start, end, kind, hashlib.sha256(value.encode()).hexdigest()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    """Spans as kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the placeholder."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(docs: DataFrame, kept: int, doc_id: Column, text: Column, owner: Column, repository: Column) -> DataFrame:
    """The first ``kept`` columns, the row's key, owner and repository, the base spans, and their values and the candidates as ``found``."""
    names = docs.columns[:kept]
    source = docs.select(*names, doc_id.cast("string").alias("_id"), text.alias("_text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("hash", pa.string())]))
        for batch in batches:
            keys, counts, sums, spans, found = [], [], [], [], []
            for i, t in zip(batch.column(kept).to_pylist(), batch.column(kept + 1).to_pylist()):
                base = base_spans(t)
                said = joined(base)
                keys.append(hashlib.blake2b(f"{i}\0{t}".encode(), digest_size=16).digest())
                counts.append([sum(kind == k for _, kind, _ in base) for k in range(3)])
                sums.append(hashlib.sha256(said.encode()).hexdigest())
                spans.append(said)
                values = base_values(t, base) + [(a, b, CANDIDATE, h) for a, b, h in candidates(t, base)]
                found.append([{"start": a, "end": b, "kind": k, "hash": h} for a, b, k, h in values])
            numbers = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else ((), (), ()))]
            columns = [*batch.columns[:kept], pa.array(keys, pa.binary()), batch.column(kept + 2), batch.column(kept + 3), *numbers, pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(found, kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "key", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])

    schema = source.select(*names).schema.add("key", "binary").add("owner", "string").add("repository", "string")
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, "long")
    return source.mapInArrow(run, schema.add("base_sha256", "string").add("base", "string").add("found", _FOUND))


def ownership(found: DataFrame) -> DataFrame:
    """``hash``, ``n_owners``, ``n_repositories``, ``live`` and ``n``, the number of rows, of all values (hash, owner, repository).

    Distinct triples are formed before the shuffle, so an example that a third of all documents copy costs a row
    for each owner and task. A null owner or repository counts as one of its own.
    """
    triples = found.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).agg(F.count("*").alias("n"))
    by_owner = triples.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    counted = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n"))
    return counted.withColumn("live", (F.col("n_owners") <= OWNERS) & (F.col("n_repositories") <= REPOSITORIES))


def _each(scanned: DataFrame) -> DataFrame:
    """A row for each value found."""
    return scanned.select("key", "owner", "repository", F.explode("found").alias("c")).select("key", "owner", "repository", "c.*")


def _facts(scanned: DataFrame, each: DataFrame) -> DataFrame:
    """``each`` with the ownership of its value; values that very many rows hold stay where they are."""
    total = scanned.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    return join_facts(each, saved(ownership(_each(scanned))), "hash", total)


def _added(scanned: DataFrame) -> DataFrame:
    """``key`` and ``live``: the spans (start, end) of its live candidates, in order."""
    live = _facts(scanned, _each(scanned).where(F.col("kind") == CANDIDATE)).where("live")
    return live.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("live"))


def _judged(scanned: DataFrame) -> DataFrame:
    """``key`` and ``judged``: all its values with their verdicts, in order."""
    verdict = F.struct("start", "kind", "end", "live", "n_owners", "n_repositories")
    return _facts(scanned, _each(scanned)).groupBy("key").agg(F.sort_array(F.collect_set(verdict)).alias("judged"))


def query(docs: DataFrame, verdicts: bool = False) -> DataFrame:
    """Counts, digest and spans of each row of ``docs``; owner is the source, a repository a source and language.

    A null text counts as empty and has no spans. Repeated rows give a row each and count once for ownership; a
    null source or language is an owner or repository of its own; an empty table gives an empty result; other
    columns are ignored. With ``verdicts`` further columns tell live values from examples: n_live_base and n_examples
    count base spans with a live value, and values of either sort that are examples; verdicts has each value as
    kind:start:end:verdict:owners:repositories, comma-joined.
    """
    source = docs.select("doc_id", text_of().alias("t"), "source", "lang")
    repository = F.concat_ws("/", "source", "lang")
    scanned = saved(_scan(source.select("doc_id", "t", "source", "lang"), 1, F.col("doc_id"), F.col("t"), F.col("source"), repository))
    rows = scanned.join(_judged(scanned), "key", "left")
    base = F.filter(F.split("base", ","), lambda x: x != "")
    place = lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(x, F.lit(":"), F.lit(1))).alias("kind"), x.alias("said"))
    judged = F.coalesce("judged", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,n_owners:bigint,n_repositories:bigint>>"))
    live = F.transform(F.filter(judged, lambda x: x["live"] & (x["kind"] == CANDIDATE)), lambda x: F.concat_ws(":", F.lit("live"), x["start"], x["end"]))
    spans = F.transform(F.array_sort(F.transform(F.concat(base, live), place)), lambda x: x["said"])
    count = lambda which: F.size(F.filter(judged, which)).cast("long")
    said = F.transform(judged, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, VALUES)), x["kind"]), x["start"], x["end"], F.when(x["live"], "live").otherwise("example"), x["n_owners"], x["n_repositories"]))
    more = [
        count(lambda x: x["live"] & (x["kind"] != CANDIDATE)).alias("n_live_base"),
        count(lambda x: ~x["live"]).alias("n_examples"),
        F.array_join(said, ",").alias("verdicts"),
    ]
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size(live).cast("long").alias("n_live"), *(more if verdicts else ()))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all base and live spans replaced in ``text``, and ``n_chars`` counted anew where it changed.

    Rows without a secret stay as they are, null texts included. Only rows with candidates wait for the counts
    over the corpus, base values included; the others are redacted in the scan's own stage.
    """
    names = docs.columns
    ks = [f"k{i}" for i in range(len(names))]
    doc_id, text, source, lang = (F.col(f"k{names.index(c)}") for c in ("doc_id", "text", "source", "lang"))
    rows = docs.toDF(*ks)
    scanned = saved(_scan(rows, len(ks), doc_id, F.coalesce(text, F.lit("")), source, F.concat_ws("/", source, lang)))
    waits = F.exists("found", lambda x: x["kind"] == CANDIDATE)
    plain = scanned.where(~waits).withColumn("live", F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    waiting = scanned.where(waits).join(_added(scanned), "key", "left")
    both = plain.select(*ks, "base", "live").union(waiting.select(*ks, "base", "live"))
    at, schema = names.index("text"), rows.schema
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lengths = batch.column(chars).to_pylist() if chars is not None else []
            for i, (base, live) in enumerate(zip(batch.column(len(ks)).to_pylist(), batch.column(len(ks) + 1).to_pylist())):
                spans = [(x["start"], x["end"]) for x in live or []] + [tuple(map(int, x.split(":")[1:])) for x in base.split(",") if x]
                if spans:
                    texts[i] = redacted(texts[i], spans)
                    if chars is not None:
                        lengths[i] = len(texts[i])
            columns = list(batch.columns[: len(ks)])
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array(lengths, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, ks)

    return both.mapInArrow(run, schema).toDF(*names)
