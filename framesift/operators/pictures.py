"""Thumbnails, display pictures and their hashes, from bytes.

A cascade of decoders: the thumbnail stored in a file, the file at an eighth of its size, the whole file by Spark's
reader. Each rung takes what the one before left and is recorded. Whatever the rung, the hash comes from the bytes of
the thumbnail that is stored, so a fresh hash and one of a cached thumbnail agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions.hashing import difference_hash, hash_text, luma
from framesift.functions.capture import extension
from framesift.operators.pages import to_display
from framesift.schema import EXTENSIONS
from framesift.sources import exif, heads, images, jpeg
from framesift.storage import saved

#: Long sides and quality of stored pictures, and that of a thumbnail in a file that is large enough to be used.
THUMBNAIL_EDGE, QUALITY, LEAST_EDGE = 256, 82, 96
RUNGS = ("exif_thumbnail", "jpeg_scaled", "full_decode")
#: Pictures that are worked on at once.
AT_ONCE = 64
#: Bytes of files that are decoded whole at once, apart from a larger one.
GROUP_BYTES = 1 << 20

_STORED = "thumbnail binary, width int, height int, error string"


def upright(rgb: np.ndarray, orientation: int | None) -> np.ndarray:
    """A picture turned as its EXIF orientation says; any value but 2 to 8 turns nothing."""
    if orientation is None or not 2 <= orientation <= 8:
        return rgb
    turned = rgb.swapaxes(0, 1) if orientation >= 5 else rgb
    down, across = {2: (1, -1), 3: (-1, -1), 4: (-1, 1), 5: (1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}[orientation]
    return turned[::down, ::across]


def _shares(old: int, new: int, reach: float) -> np.ndarray:
    """(new, old): the weights of old pixels in each new one, falling to 0 at ``reach`` new pixels from its middle."""
    ratio = old / new
    middle, width = (np.arange(new) + 0.5) * ratio, max(ratio, 1.0) * reach
    far = np.abs(np.arange(old)[None, :] + 0.5 - middle[:, None]) / width
    shares = np.clip(1 - far, 0, None)
    return shares / shares.sum(axis=1, keepdims=True)


def _areas(old: int, new: int) -> np.ndarray:
    """(new, old): the share of each old pixel in each new one's area."""
    edges = np.arange(new + 1) * old / new
    at = np.arange(old)
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * new / old


def fitted(rgb: np.ndarray, edge: int) -> np.ndarray:
    """A picture with its long side at ``edge`` or less, by the mean of areas; never enlarged, no side below 1."""
    height, width = rgb.shape[:2]
    if max(height, width) <= edge:
        return rgb
    new_height, new_width = (max(1, round(side * edge / max(height, width))) for side in (height, width))
    rows = np.tensordot(_areas(height, new_height), rgb.astype(np.float64), 1)
    return np.clip(np.rint(np.einsum("xw,hwc->hxc", _areas(width, new_width), rows)), 0, 255).astype(np.uint8)


def grid_of(rgb: np.ndarray, width: int = 9, height: int = 8) -> np.ndarray:
    """(height, width, 3): a picture scaled to a grid, each cell a mean that falls off to the next cells' middles."""
    rows = np.tensordot(_shares(rgb.shape[0], height, 1.0), rgb.astype(np.float64), 1)
    return np.clip(np.rint(np.einsum("xw,hwc->hxc", _shares(rgb.shape[1], width, 1.0), rows)), 0, 255).astype(np.int64)


def _mapped(rows: DataFrame, content: str, keep: tuple[str, ...], work: Callable[[list, dict[str, list]], list[tuple]], out: str) -> DataFrame:
    """``keep`` and the columns ``out``: what ``work`` makes of bytes, a few pictures at a time; the columns kept are at hand."""
    source = rows.select(*keep, content)
    names = [c.strip().split()[0] for c in out.split(",")]
    schema = T.StructType.fromDDL(out)
    kinds = [pa.binary() if f.dataType.typeName() == "binary" else pa.int32() if f.dataType.typeName() == "integer" else pa.list_(pa.int32()) if f.dataType.typeName() == "array" else pa.string() for f in schema]
    full = source.select(*keep).schema
    for f in schema:
        full = full.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                held = {c: batch.column(i).to_pylist() for i, c in enumerate(keep)}
                made = work(batch.column(len(keep)).to_pylist(), held)
                columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *names])

    return source.mapInArrow(run, full)


def _stored(pictures: list[np.ndarray | str], orientations: list[int | None], edge: int, least: int = 0) -> list[tuple]:
    """(thumbnail, width, height, error) of decoded pictures, or of reasons why they could not be."""
    out = []
    for picture, orientation in zip(pictures, orientations):
        if isinstance(picture, str) or max(picture.shape[:2]) < least:
            out.append((None, None, None, picture if isinstance(picture, str) else "too small"))
            continue
        small = fitted(upright(picture, orientation), edge)
        out.append((jpeg.encoded(small, QUALITY), small.shape[1], small.shape[0], None))
    return out


def from_stored_thumbnails(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keep``, orientation, thumbnail, width, height and error of files with the columns of ``exif.read`` and ``head``: the rung of thumbnails in EXIF data."""
    rows = files.withColumn("_bytes", exif.thumbnail())

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        pictures = iter(jpeg.decoded([c for c in contents if c]))
        return _stored([next(pictures) if c else "no thumbnail" for c in contents], held["orientation"], THUMBNAIL_EDGE, LEAST_EDGE)

    return _mapped(rows, "_bytes", (*keep, "orientation"), work, _STORED)


def from_eighths(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The rung of whole JPEG files (``content``, orientation) read at an eighth of their size."""

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        return _stored(jpeg.eighths([c or b"" for c in contents]), held["orientation"], THUMBNAIL_EDGE)

    return _mapped(files, "content", (*keep, "orientation"), work, _STORED)


def from_pixels(pictures: DataFrame, edge: int = THUMBNAIL_EDGE, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The rung of pictures that Spark's reader decoded: width, height, channels, data (blue first) and orientation."""
    rows = pictures.withColumnsRenamed({"width": "_w", "height": "_h"})

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        out = []
        for data, w, h, n in zip(contents, held["_w"], held["_h"], held["channels"]):
            if data is None:
                out.append("can't be decoded")
                continue
            pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
            out.append(pixels[:, :, 2::-1] if n >= 3 else pixels.repeat(3, axis=2))
        return _stored(out, held["orientation"], edge)

    return _mapped(rows, "data", (*keep, "_w", "_h", "channels", "orientation"), work, _STORED).drop("_w", "_h", "channels")


def hashed(stored: DataFrame, keep: tuple[str, ...] = ("path",), content: str = "thumbnail") -> DataFrame:
    """``keep`` and ``d_hash`` of stored pictures, from their bytes; null where there are none or they can't be read."""

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        pictures = iter(jpeg.decoded([c for c in contents if c]))
        grids = [grid_of(p) if c and not isinstance(p := next(pictures), str) else None for c in contents]
        return [tuple(g[:, :, i].ravel().tolist() for i in range(3)) if g is not None else (None, None, None) for g in grids]

    cells = _mapped(stored, content, keep, work, "red array<int>, green array<int>, blue array<int>")
    grid = F.transform(F.arrays_zip("red", "green", "blue"), lambda p: luma(p["red"], p["green"], p["blue"]))
    return cells.withColumn("_grid", grid).select(*keep, F.when(F.col("red").isNotNull(), hash_text(difference_hash(F.col("_grid")))).alias("d_hash"))


def ladder(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """path, source (the rung), thumbnail, width, height, d_hash and error of files (path) below ``folder``.

    Files with a thumbnail of ``LEAST_EDGE`` or more in their EXIF data are read no further than that; of the others,
    baseline JPEG files are read at an eighth of their size, and whatever is left is decoded whole. A file that no rung can
    read, or that ends before its picture does, has an error. Pictures are upright in all rungs.
    """
    read = exif.read(heads.heads(files, enough=exif.enough), keep=("path", "head"))
    first = saved(from_stored_thumbnails(read, ("path", "own_orientation")))
    left = first.where("error is not null").select("path", F.col("own_orientation").alias("orientation"))
    second = saved(from_eighths(heads.heads(left, -1, ("path", "orientation")).withColumnRenamed("head", "content")))
    failed = second.where("error is not null")
    over = failed.where(F.col("error").isin(*jpeg.CUT_OFF))
    last = failed.where(~F.col("error").isin(*jpeg.CUT_OFF))
    # of Spark's reader only files of the kinds that are left: it takes folders, not rows
    kinds = sorted(r[0] for r in last.select(F.regexp_extract("path", r"[.]([^./]+)$", 1)).where(extension(F.col("path")).isin(*EXTENSIONS)).distinct().collect())  # a few spellings
    columns = ["path", "source", "thumbnail", "width", "height", "error"]
    rest = [f.where("error is null").withColumn("source", F.lit(rung)).select(*columns) for f, rung in ((first, RUNGS[0]), (second, RUNGS[1]))]
    rest.append((over if kinds else failed).withColumn("source", F.lit(None).cast("string")).select(*columns))
    if kinds:
        third = saved(from_pixels(last.select("path", "orientation").join(images.decoded(spark, folder, f"*.{{{','.join(kinds)}}}").drop("error"), "path", "left")))
        rest.append(third.withColumn("source", F.when(F.col("error").isNull(), F.lit(RUNGS[2]))).select(*columns))
    stored = reduce(DataFrame.unionByName, rest)
    return stored.join(hashed(stored), "path").select("path", "source", "thumbnail", "width", "height", "d_hash", "error")


def _in_groups(contents: list) -> Iterator[tuple[int, np.ndarray | str]]:
    """The place and picture (or reason) of all files that are not None, so many at a time as have ``GROUP_BYTES`` together."""
    held, size = [], 0
    for i, content in enumerate(contents):
        if content is not None:
            held.append(i)
            size += len(content)
        if held and (size >= GROUP_BYTES or i == len(contents) - 1):
            yield from zip(held, jpeg.decoded([contents[j] for j in held]))
            held, size = [], 0


def display(rows: DataFrame, edge: Column | int, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keep``, display (JPEG bytes), display_edge, origin and error of pictures at a long side of ``edge`` or less.

    ``rows`` has display (what is stored, or null), display_edge, original (bytes, or null) and orientation. A stored picture of
    that edge or more is made smaller; else the original is decoded, as a larger picture can't come from a smaller one. If the
    stored bytes can't be read, the original is taken as well.
    """
    wanted = rows.withColumn("_edge", edge if isinstance(edge, Column) else F.lit(edge)).withColumn("_reuse", F.col("display").isNotNull() & (F.col("display_edge") >= F.col("_edge")))
    wanted = wanted.withColumn("_stored", F.when(F.col("_reuse"), F.col("display"))).withColumn("_turn", F.col("orientation"))

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        out: list[tuple | None] = [None] * len(contents)

        def put(i: int, picture: np.ndarray, origin: str) -> None:
            out[i] = jpeg.encoded(fitted(picture, held["_edge"][i]), QUALITY), held["_edge"][i], origin, None

        for i, picture in _in_groups(held["_stored"]):
            if not isinstance(picture, str):
                put(i, picture, "stored")
        for i, picture in _in_groups([c or b"" if out[i] is None else None for i, c in enumerate(contents)]):
            if isinstance(picture, str):
                out[i] = None, None, None, picture
            else:
                put(i, upright(picture, held["_turn"][i]), "original")
        return out

    made = _mapped(wanted.drop("display", "display_edge"), "original", (*keep, "_stored", "_edge", "_turn"), work, "display binary, display_edge int, origin string, error string")
    return made.drop("_stored", "_edge", "_turn")


def build_displays(photos: DataFrame, edge: int, stored: DataFrame) -> DataFrame:
    """project_id, id, display, display_edge, origin and error of all photos without a display picture of this edge.

    ``stored`` has project_id, id and display, the pictures there are. Those that are large enough are made smaller, and
    their originals are not read; of all others, and of those that can't be read, the originals (``path``) are. Written,
    as each picture is made once.
    """
    keys = ["project_id", "id"]
    wanted = saved(to_display(photos, edge).select(*keys, "path", "display_edge"))
    nothing = F.lit(None).cast("binary")
    near = wanted.where(F.col("display_edge") >= edge).join(stored.select(*keys, "display"), keys).withColumn("original", nothing).withColumn("orientation", F.lit(1))
    reused = saved(display(near, edge, tuple(keys))).where("error is null")
    left = wanted.join(reused.select(*keys), keys, "left_anti")
    read = exif.read(heads.heads(left, -1, (*keys, "path")), keep=(*keys, "head")).select(*keys, F.col("head").alias("original"), F.col("own_orientation").alias("orientation"))
    made = display(read.withColumn("display", nothing).withColumn("display_edge", F.lit(None).cast("int")), edge, tuple(keys))
    return reused.unionByName(saved(made))


def write_displays(photos: DataFrame, built: DataFrame, folder: str) -> DataFrame:
    """``photos`` with the path and edge of the display pictures of ``built``; where one failed, the reason instead."""
    new = built.select("project_id", "id", F.col("display_edge").alias("_edge"), F.col("error").alias("_error"), F.lit(True).alias("_built"))
    rows = photos.join(new, ["project_id", "id"], "left")
    fine = F.col("_built") & F.col("_error").isNull()
    rows = rows.withColumn("display_path", F.when(fine, F.concat(F.lit(f"{folder}/"), "id", F.lit(".jpg"))).otherwise(F.col("display_path")))
    rows = rows.withColumn("display_edge", F.when(fine, F.col("_edge")).otherwise(F.col("display_edge")))
    return rows.withColumn("analysis_error", F.when(F.col("_built") & F.col("_error").isNotNull(), F.col("_error")).otherwise(F.col("analysis_error"))).select(*photos.columns)


def mosaics(rows: DataFrame, cells: str, side: int, keep: tuple[str, ...], quality: int = 100) -> DataFrame:
    """``keep`` and ``content``: a JPEG file of ``side`` x ``side`` even squares of 8 x 8 pixels, of the given brightness in row order."""
    texts = rows.withColumn("_cells", F.array_join(F.transform(cells, lambda c: c.cast("string")), ","))

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        squares = (np.array(c.split(","), np.float64).reshape(side, side).repeat(8, axis=0).repeat(8, axis=1) for c in contents)
        return [(jpeg.encoded(np.stack([s, s, s], axis=-1), quality),) for s in squares]

    return _mapped(texts.where(F.size(cells) == side * side), "_cells", keep, work, "content binary")


def cells_of(rows: DataFrame, keep: tuple[str, ...], content: str = "content") -> DataFrame:
    """``keep``, ``cells`` and error: the brightness of JPEG files at an eighth of their size, in row order."""

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        found = jpeg.eighths([c or b"" for c in contents])
        return [(None, p) if isinstance(p, str) else (p.astype(np.int64).dot((2126, 7152, 722)).ravel().__floordiv__(10_000).tolist(), None) for p in found]

    return _mapped(rows, content, keep, work, "cells array<int>, error string")


def sizes_of(rows: DataFrame, keep: tuple[str, ...], content: str) -> DataFrame:
    """``keep``, width, height and error of JPEG files, from their headers."""

    def work(contents: list, held: dict[str, list]) -> list[tuple]:
        out = []
        for c in contents:
            try:
                h = jpeg.header(c or b"")
                out.append((h.width, h.height, None))
            except ValueError as e:
                out.append((None, None, str(e)))
        return out

    return _mapped(rows, content, keep, work, "width int, height int, error string")
