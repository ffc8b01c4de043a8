"""EXIF fields from the bytes of pictures."""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions.capture import exif_ms

#: Tags of the fields that are read, and limits on what is believed.
_DATETIME, _ORIENTATION, _EXIF_IFD, _THUMB_AT, _THUMB_LENGTH = 0x0132, 0x0112, 0x8769, 0x0201, 0x0202
_ORIGINAL, _OFFSET, _OFFSET_ORIGINAL = 0x9003, 0x9010, 0x9011
_MOST_ENTRIES, _LONGEST_TEXT = 512, 64
#: Markers that have no length.
_ALONE = frozenset((0x01, *range(0xD0, 0xDA)))

FIELDS = "original string, datetime string, offset_original string, offset string, orientation int, thumbnail_at int, thumbnail_length int, own_orientation int"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


_HEADERS = (b"II*\0", b"MM\0*")
_MARK = b"Exif\0\0"


def _segments(data: bytes) -> Iterator[tuple[int, int]]:
    """Marker and start of the content of each segment of a JPEG file, up to its pixels or the first broken length."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = 0 if data[at + 1] in _ALONE else int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] not in _ALONE:
            if size < 2:
                return
            yield data[at + 1], at + 4
        at += 2 + size


def tiff_start(data: bytes) -> int | None:
    """Where the TIFF block of a picture begins: the whole file, an EXIF segment of a JPEG file, or else after any EXIF mark.

    A mark counts only with a TIFF header behind it.
    """
    if data[:4] in _HEADERS:
        return 0
    segments = _segments(data) if data[:2] == b"\xff\xd8" else ()
    inside = (at + len(_MARK) for marker, at in segments if marker == 0xE1 and data.startswith(_MARK, at))
    anywhere = (found.end() for found in re.finditer(_MARK, data))
    return next((at for at in itertools.chain(inside, anywhere) if data[at : at + 4] in _HEADERS), None)


class _Block:
    """A TIFF block; reads beyond its end give nothing."""

    def __init__(self, data: bytes):
        self.data, self.order = data, {b"II": "<", b"MM": ">"}.get(data[:2])

    def number(self, at: int, kind: str) -> int | None:
        size = struct.calcsize(kind)
        return struct.unpack_from(self.order + kind, self.data, at)[0] if 0 <= at <= len(self.data) - size else None

    def entries(self, at: int | None) -> tuple[dict[int, int | str], int | None]:
        """Numbers and texts of a directory by tag, and where the next directory is."""
        n = self.number(at, "H") if at else None
        if n is None or n > _MOST_ENTRIES:
            return {}, None
        found: dict[int, int | str] = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count, value = (self.number(entry + d, c) for d, c in ((0, "H"), (2, "H"), (4, "I"), (8, "I")))
            if value is None:
                break
            if kind == 2 and count <= _LONGEST_TEXT:
                start = value if count > 4 else entry + 8
                found[tag] = self.data[start : start + count].split(b"\0")[0].decode("ascii", "ignore")
            elif kind == 3 and count == 1:
                found[tag] = self.number(entry + 8, "H")
            elif kind == 4 and count == 1:
                found[tag] = value
        return found, self.number(at + 2 + 12 * n, "I")


def fields(data: bytes | None) -> dict[str, int | str | None]:
    """The EXIF fields of a picture's bytes; None for each that is absent or broken."""
    start = tiff_start(data) if data else None
    block = _Block(data[start:]) if start is not None else None
    if not block or not block.order:
        return dict.fromkeys(_NAMES)
    main, following = block.entries(block.number(4, "I"))
    exif, _ = block.entries(main.get(_EXIF_IFD) if isinstance(main.get(_EXIF_IFD), int) else None)
    thumb, _ = block.entries(following)
    text = lambda d, tag: d.get(tag) if isinstance(d.get(tag), str) else None
    at, length = thumb.get(_THUMB_AT), thumb.get(_THUMB_LENGTH)
    held = isinstance(at, int) and isinstance(length, int) and 0 < length and at + length <= len(block.data)
    turned = thumb.get(_ORIENTATION) if held and isinstance(thumb.get(_ORIENTATION), int) else main.get(_ORIENTATION)
    values = (
        text(exif, _ORIGINAL), text(main, _DATETIME), text(exif, _OFFSET_ORIGINAL), text(exif, _OFFSET), turned if isinstance(turned, int) else None,
        start + at if held else None, length if held else None, main.get(_ORIENTATION) if isinstance(main.get(_ORIENTATION), int) else None,
    )
    return dict(zip(_NAMES, values))


def enough(head: bytes) -> bool:
    """Whether the first bytes of a picture hold its capture time and its thumbnail, if it says where that is."""
    found, start = fields(head), tiff_start(head)
    if start is None or not (found["original"] or found["datetime"]):
        return False
    block = _Block(head[start:])
    _, following = block.entries(block.number(4, "I"))
    thumb, _ = block.entries(following)
    return not isinstance(thumb.get(_THUMB_AT), int) or found["thumbnail_at"] is not None


def read(files: DataFrame, content: str = "head", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keep`` and the EXIF fields of a column of bytes; broken bytes give nulls, never an error."""
    source = files.select(*keep, content)
    schema = source.select(*keep).schema
    for field in FIELDS.split(", "):
        schema = schema.add(field.split()[0], T.StringType() if "string" in field else T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fields(x) for x in batch.column(len(keep)).to_pylist()]
            made = [pa.array([r[n] for r in rows], pa.string() if "string" in f else pa.int32()) for n, f in zip(_NAMES, FIELDS.split(", "))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *_NAMES])

    return source.mapInArrow(run, schema)


def capture_times(read_fields: DataFrame) -> DataFrame:
    """Adds original_ms and datetime_ms, less the picture's offset from UTC (the original's own before the other)."""
    offset = F.coalesce("offset_original", "offset")
    return read_fields.withColumn("original_ms", exif_ms(F.col("original"), offset)).withColumn("datetime_ms", exif_ms(F.col("datetime"), offset))


def thumbnail(content: str = "head") -> Column:
    """The bytes of the stored thumbnail; null if there is none."""
    return F.when(F.col("thumbnail_at").isNotNull(), F.substring(F.col(content), F.col("thumbnail_at") + 1, F.col("thumbnail_length")))
