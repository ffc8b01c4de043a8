"""Layouts of exports, and bytes to write: archives, rating packets, copies of files."""

from __future__ import annotations

import io
import os
import shutil
import time
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from framesift.functions.capture import extension, stem
from framesift.operators.curation import placed
from framesift.operators.pages import visible
from framesift.schema import ERRORS_SHOWN
from framesift.sources import placing
from framesift.storage import saved


def of_ratings(photos: DataFrame, project: str, ratings: list[int] | None = None) -> DataFrame:
    """Visible photos of a project with one of the ratings; none given means all."""
    rows = visible(photos, project)
    return rows.where(F.col("rating").isin(list(ratings))) if ratings else rows


def candidates(photos: DataFrame, project: str, ratings: list[int] | None = None) -> DataFrame:
    """What an export takes, the best ratings first."""
    return of_ratings(photos, project, ratings).orderBy(F.desc("rating"), "relative_path", "id")


#: The extension of a name with its dot.
_DOT = r"(?<=.)(\.[^.]*)$"


def _numbered(name: Column, n: Column) -> Column:
    dot = F.regexp_extract(name, _DOT, 1)
    return F.when(n < 2, name).otherwise(F.concat(stem(name), F.lit(" ("), n, F.lit(")"), dot))


def _taken(names: DataFrame) -> DataFrame:
    """(project_id, rating, name, _t): the numbers that files' own names take from other names, as "a (2).jpg" takes 2 from "a.jpg"."""
    parts = r"^(.+) \(([1-9][0-9]{0,8})\)$"
    own = names.withColumn("_stem", stem(F.col("name"))).where(F.col("_stem").rlike(parts))
    dot = F.regexp_extract("name", _DOT, 1)
    of = own.withColumn("_t", F.regexp_extract("_stem", parts, 2).cast("bigint")).withColumn("_base", F.concat(F.regexp_extract("_stem", parts, 1), dot))
    whole = of.where((F.col("_t") > 1) & (_numbered(F.col("_base"), F.col("_t")) == F.col("name")))
    return whole.select("project_id", "rating", F.col("_base").alias("name"), "_t")


def layout(files: DataFrame) -> DataFrame:
    """``target``: star-N/name for every row (project_id, rating, name, relative_path, id), no two alike.

    The first of rows with one name keeps it, the next are name (2), name (3), ... with the numbers left out that are
    in files' own names. The k-th number that is free follows from one count: a number t that is taken, the j-th of its
    name, stands before the rows from the (t - j)-th on, so a row's number is its place among both. Places come by ranges,
    so that one name for all files is no task of its own, whatever the numbers taken.
    """
    own = ["project_id", "rating", "name"]
    rows = placed(files, [(F.asc, "relative_path"), (F.asc, "id")], *own).withColumnRenamed("place", "_n")
    taken = _taken(files.select(*own).distinct())
    if not taken.isEmpty():
        rows = saved(rows)
        more = rows.where("_n > 1").select(*own, (F.col("_n") - 1).alias("_k"), F.lit(1).alias("_row"), "id")
        used = placed(taken.join(more.select(*own).distinct(), own, "left_semi"), [(F.asc, "_t")], *own)
        marks = used.select(*own, (F.col("_t") - F.col("place")).alias("_k"), F.lit(0).alias("_row"), F.lit(None).cast(more.schema["id"].dataType).alias("id"))
        free = placed(more.union(marks), [(F.asc, "_k"), (F.asc, "_row")], *own).where("_row = 1").select(*own, (F.col("_k") + 1).alias("_n"), (F.col("place") + 1).alias("_free"))
        rows = rows.join(free, [*own, "_n"], "left").withColumn("_n", F.coalesce("_free", "_n")).drop("_free")
    return rows.withColumn("target", F.concat(F.lit("star-"), F.col("rating"), F.lit("/"), _numbered(F.col("name"), F.col("_n")))).drop("_n")


def write_table(files: DataFrame, path: str) -> None:
    """Rows as Parquet, one folder a rating."""
    files.write.mode("errorifexists").partitionBy("rating").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Measurements as CSV with a header."""
    rows.write.mode("errorifexists").option("header", True).csv(path)


def place_files(files: DataFrame, destination: str, source_root: str, move: bool = False) -> DataFrame:
    """Copy or move files (id, path, target) below ``destination``, all or none: id, status and error of each.

    For media on a file system that all executors mount. A missing file is skipped; a failure of one file is a row, not
    an exception. A job that fails leaves the destination as it was. A destination within the source folder raises.
    """
    inside = os.path.commonpath([os.path.abspath(destination), os.path.abspath(source_root)]) == os.path.abspath(source_root)
    if inside:
        raise ValueError("the destination lies in the source folder")
    return placing.placed(files.select("id", "path", "target"), placing.copied, destination, move)


def report(outcomes: DataFrame) -> DataFrame:
    """One row: numbers of files by outcome, and the first errors."""
    errors = outcomes.where("status = 'failed'").orderBy("id").limit(ERRORS_SHOWN).agg(F.sort_array(F.collect_list(F.struct("id", "error"))).alias("errors"))
    counts = outcomes.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")))
    return counts.crossJoin(errors.select(F.transform("errors", lambda x: x["error"]).alias("errors")))


def after_move(photos: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``photos`` with the files that were moved away marked as missing, and only those."""
    gone = outcomes.where("status = 'processed'").select("id", F.lit(True).alias("_gone"))
    return photos.join(gone, "id", "left").withColumn("is_missing", F.coalesce("_gone", "is_missing")).drop("_gone").select(*photos.columns)


def stored_zip(entries: list[tuple[str, bytes, int]]) -> bytes:
    """An archive of (name, bytes, epoch ms) without compression; for the few files that one download holds."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name, data, at in entries:
            moment = max(time.gmtime(at / 1000)[:6], (1980, 1, 1, 0, 0, 0))
            archive.writestr(zipfile.ZipInfo(name, moment), data)
    return out.getvalue()


def zip_shards(files: DataFrame, shard_bytes: int = 64 << 20) -> DataFrame:
    """(shard, archive): stored archives of (target, content, modified_ms), each of bounded size."""
    size = F.octet_length("content")
    total = files.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_bytes))
    rows = files.withColumn("shard", F.pmod(F.xxhash64("target"), F.lit(n)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        parts = sorted(zip(group.column("target").to_pylist(), group.column("content").to_pylist(), group.column("modified_ms").to_pylist()))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "archive": pa.array([stored_zip(parts)], pa.binary())})

    return rows.select("shard", "target", "content", "modified_ms").groupBy("shard").applyInArrow(pack, "shard int, archive binary")


def rating_packet(rating: int) -> bytes:
    """A metadata packet that holds a rating."""
    return (
        '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/">'
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/">'
        f"<xmp:Rating>{rating}</xmp:Rating></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end=\"w\"?>"
    ).encode()


_XMP = b"http://ns.adobe.com/xap/1.0/\0"


def rated_jpeg(data: bytes, rating: int) -> bytes:
    """A JPEG file with its rating packet replaced, or added after its last APP1 segment (else as its first); pixels stay.

    Raises ValueError for bytes that are no whole JPEG file: without the marks of its start and its end where they
    belong, or with a segment whose length can't be right.
    """
    if data[:2] != b"\xff\xd8" or len(data) < 4 or data[-2:] != b"\xff\xd9":
        raise ValueError("not a whole JPEG file")
    body = _XMP + rating_packet(rating)
    packet = b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body
    before, after, at = [data[:2]], [], 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        segment, at = data[at : at + 2 + size], at + 2 + size
        if size < 2 or at > len(data):
            raise ValueError("a segment is cut off")
        if segment[1] == 0xE1 and segment.startswith(_XMP, 4):
            continue
        after.append(segment)
        if segment[1] == 0xE1:
            before, after = before + after, []
    return b"".join([*before, packet, *after, data[at:]])


def with_ratings(files: DataFrame) -> DataFrame:
    """(id, content, error) of files (id, content, rating): JPEG bytes with the rating; an error where that fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append((row["id"], rated_jpeg(row["content"] or b"", row["rating"] or 0), None))
                except ValueError as e:
                    out.append((row["id"], None, str(e)))
            ids, contents, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["id", "content", "error"])

    return files.select("id", "content", "rating").mapInArrow(run, "id string, content binary, error string")


def rated_copy(row: Row, staged: str) -> None:
    """A copy of the JPEG file at ``path`` with its rating, read back and compared."""
    with open(row["path"], "rb") as f:
        data = rated_jpeg(f.read(), row["rating"] or 0)
    with open(staged, "wb") as f:
        f.write(data)
    with open(staged, "rb") as f:
        if f.read() != data:
            raise OSError("what was written differs")
    shutil.copystat(row["path"], staged)


def write_ratings(files: DataFrame) -> DataFrame:
    """Write the ratings of files (id, path, rating) into the JPEG files themselves: id, status and error of each.

    For originals on a file system that all executors mount. New bytes are staged beside the originals and compared, and
    take their names, each in one step, once all are staged; a job that fails changes nothing, a repeat writes the same bytes.
    """
    return placing.placed(files.select("id", "path", "rating"), rated_copy)


def writable(photos: DataFrame) -> DataFrame:
    """Photos whose files can hold a rating packet."""
    return photos.where(extension(F.col("name")).isin("jpg", "jpeg"))
