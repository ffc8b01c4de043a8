"""Column functions on literal values."""

import math

import pytest
from framesift.functions import capture, hashing, scalars
from pyspark.sql import functions as F

AT = 1_782_843_572_000  # 2026-06-30 18:19:32 UTC


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("IMG_20260630_181932.jpg", AT), ("2026-06-30_18-19-32.png", AT), ("20260630181932.jpg", AT), ("12_IMG_20260630_181932.jpg", AT), ("IMG_1234.HEIC", None), ("20261330181932.jpg", None),
        ("20230230_101010.jpg", None), (".jpg", None), ("", None), ("20260630_181960.jpg", AT + 28_000), ("18991231_235959", None), ("20260630_241932", None), ("99999999999999999999_x", None),
    ],
)
def test_filename_time(spark, name, expected):
    assert one(spark, capture.filename_ms(F.lit(name))) == expected


@pytest.mark.parametrize(
    ("text", "offset", "expected"),
    [
        ("2026:06:30 18:19:32", None, AT), ("2026-06-30T18:19:32", None, AT), ("2026:06:30 18:19:32", "+09:00", AT - 9 * 3_600_000), ("2026:06:30 18:19:32", "-05:30", AT + 19_800_000),
        ("2026:06:30 18:19:32", "+24:00", AT), ("2026:06:30 18:19:32", "nine", AT), ("2026:02:30 18:19:32", None, None), ("0000:00:00 00:00:00", None, None), ("", None, None), (None, None, None), ("2024:02:29 00:00:00", None, 1_709_164_800_000),
    ],
)
def test_exif_time(spark, text, offset, expected):
    assert one(spark, capture.exif_ms(F.lit(text).cast("string"), F.lit(offset).cast("string"))) == expected


def test_precedence(spark):
    n = F.lit(None).cast("bigint")
    pick = lambda *a: tuple(one(spark, capture.resolve(*a)))
    assert pick(F.lit(1), F.lit(2), F.lit("x"), F.lit(3)) == (1, "exif_original")
    assert pick(n, F.lit(2), F.lit("IMG_20260630_181932.jpg"), F.lit(3)) == (2, "exif_datetime")
    assert pick(n, n, F.lit("IMG_20260630_181932.jpg"), F.lit(3)) == (AT, "filename_inferred")
    assert pick(n, n, F.lit("x.jpg"), F.lit(3)) == (3, "filesystem_mtime")
    assert pick(n, n, F.lit("x.jpg"), n) == (None, "unknown")


def test_names(spark):
    assert [one(spark, capture.stem(F.lit(x))) for x in ("a.b.jpg", ".hidden", "x", "a.")] == ["a.b", ".hidden", "x", "a"]
    assert [one(spark, capture.extension(F.lit(x))) for x in ("a.JPG", ".jpg", "x", "d.d/x")] == ["jpg", "", "", ""]


def test_hashes(spark):
    d = lambda a, b: one(spark, hashing.distance(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert d("0" * 16, "f" * 16) == 64 and d("aabbccddeeff0011", "aabbccddeeff0011") == 0 and d("8000000000000000", "0") == 1
    assert d("zz", "0") == 64 and d(None, "0") == 64 and d("1" * 17, "0") == 64 and d("", "0") == 64
    assert one(spark, hashing.hash_text(hashing.hash_bits(F.lit("F00000000000000A")))) == "f00000000000000a"
    grid = lambda cells: one(spark, hashing.hash_text(hashing.difference_hash(F.lit(cells))))
    assert grid([5] * 72) == "0" * 16 and grid([x for _ in range(8) for x in range(9)]) == "0" * 16 and grid([-x for _ in range(8) for x in range(9)]) == "f" * 16
    assert grid([1] + [0] * 71) == f"{1:016x}" and grid([0] * 70 + [1, 0]) == f"{1 << 63:016x}"
    assert [one(spark, hashing.luma(*map(F.lit, p))) for p in ((255, 255, 255), (0, 0, 0), (255, 0, 0))] == [255, 0, 54]


def test_scalars(spark):
    get = lambda f, *a: one(spark, f(*(F.lit(x) for x in a)))
    assert [get(scalars.clamped_rating, x) for x in (-3, 0, 5, 9)] == [0, 0, 5, 5]
    assert [get(scalars.group_size, x) for x in (1.0, 3.4, 3.5, 99.0, math.nan, math.inf)] == [2, 3, 4, 10, 10, 10]
    assert get(lambda x: scalars.group_size(x, large=False), math.nan) == 4
    assert [get(scalars.display_edge, x) for x in (768, 1000, 1920)] == [768, 1024, 1920]
    edge = lambda p, s: one(spark, scalars.resolved_edge(F.lit(p).cast("bigint"), F.lit(s).cast("string")))
    assert [edge(1536, "768"), edge(None, "768"), edge(None, "large"), edge(None, None)] == [1536, 768, 1024, 1024]
    assert tuple(get(scalars.fit_long_edge, 4000, 3000, 1024)) == (1024, 768) and tuple(get(scalars.fit_long_edge, 800, 600, 1024)) == (800, 600) and tuple(get(scalars.fit_long_edge, 9000, 1, 768)) == (768, 1)
    assert [get(scalars.known_source, x) for x in ("exif_original", "other")] == ["exif_original", "unknown"]
    assert [get(scalars.is_weak, x) for x in ("exif_original", "filesystem_mtime", "other")] == [False, True, True]
    assert get(scalars.percentage, 1, 0) == 0 and get(scalars.percentage, 1, 4) == 25
    assert tuple(get(scalars.dos_date_time, AT)) == ((46 << 9) | (6 << 5) | 30, (18 << 11) | (19 << 5) | 16) and tuple(get(scalars.dos_date_time, 0)) == (33, 0)
    assert get(scalars.toggled, ["a"], "b") == ["a", "b"] and get(scalars.toggled, ["a", "b"], "b") == ["a"]
    assert get(scalars.is_selected, True, ["a"], "a") is False and get(scalars.selected_count, True, ["a"], 5) == 4 and get(scalars.selected_count, False, ["a"], 5) == 1
    assert one(spark, scalars.crc32(F.lit(b"123456789"))) == 0xCBF43926
