"""File listings, heads, EXIF, analysis of files and exports."""

import os
import struct
import time
import zipfile
import zlib
from io import BytesIO

import pytest
from framesift.operators import analysis, export
from framesift.sources import exif, heads, images, listing
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tiff(order="<", datetime=None, original=None, offset=None, orientation=None, thumbnail=None):
    """A TIFF block with the given fields, built entry by entry."""
    extra, base = b"", 8

    def directory(entries, at, following):
        nonlocal extra
        out, tail_at, tail = struct.pack(order + "H", len(entries)), at + 2 + 12 * len(entries) + 4, b""
        for tag, kind, value in entries:
            if kind == 2:
                raw = value.encode() + b"\0"
                out += struct.pack(order + "HHII", tag, 2, len(raw), tail_at + len(tail)) if len(raw) > 4 else struct.pack(order + "HHI", tag, 2, len(raw)) + raw.ljust(4, b"\0")
                tail += raw if len(raw) > 4 else b""
            elif kind == 3:
                out += struct.pack(order + "HHIHH", tag, 3, 1, value, 0)
            else:
                out += struct.pack(order + "HHII", tag, 4, 1, value)
        return out + struct.pack(order + "I", following) + tail

    sub = [(0x9003, 2, original)] * bool(original) + [(0x9011, 2, offset)] * bool(offset)
    main = [(0x0112, 3, orientation)] * bool(orientation) + [(0x0132, 2, datetime)] * bool(datetime) + [(0x8769, 4, 0)]
    first = directory(main, base, 0)
    sub_at = base + len(first)
    main[-1] = (0x8769, 4, sub_at)
    second = directory(sub, sub_at, 0)
    third_at = sub_at + len(second) if thumbnail else 0
    third = b""
    if thumbnail:
        size = len(directory([(0x0201, 4, 0), (0x0202, 4, 0)], third_at, 0))
        third = directory([(0x0201, 4, third_at + size), (0x0202, 4, len(thumbnail))], third_at, 0) + thumbnail
    first = directory(main, base, third_at)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", base) + first + second + third


def jpeg(block=None, segments=()):
    out = b"\xff\xd8\xff\xe0\x00\x04ab"
    for marker, body in [(0xE1, b"Exif\0\0" + (block or b""))] * (block is not None) + list(segments):
        out += bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    return out + b"\xff\xda\x00\x02pixels\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_fields(order):
    block = tiff(order, "2026:06:30 18:19:32", "2026:06:30 18:19:30", "+09:00", 6, b"thumb")
    for data in (jpeg(block), block, b"....ftypheic....Exif\0\0" + block):
        f = exif.fields(data)
        assert (f["original"], f["datetime"], f["offset_original"], f["orientation"]) == ("2026:06:30 18:19:30", "2026:06:30 18:19:32", "+09:00", 6)
        assert data[f["thumbnail_at"] : f["thumbnail_at"] + f["thumbnail_length"]] == b"thumb"
    for broken in (None, b"", b"\xff\xd8", jpeg(), jpeg(block[:9]), jpeg(b"II*\0\xff\xff\xff\x7f"), block[:30]):
        assert set(exif.fields(broken)) == set(exif._NAMES)


def test_scan_heads_and_times(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/IMG.JPG").write_bytes(jpeg(tiff("<", original="2026:06:30 18:19:32", offset="+09:00")))
    (tmp_path / "a/b/x.png").write_bytes(b"no picture")
    (tmp_path / "a/b/note.txt").write_bytes(b"text")
    os.utime(tmp_path / "a/b/x.png", (1000, 1000))
    found = {r["relative_path"]: r for r in listing.scan(spark, str(tmp_path), "p").collect()}
    assert set(found) == {"a/IMG.JPG", "a/b/x.png"}
    assert (found["a/b/x.png"]["mtime"], found["a/b/x.png"]["size"], found["a/b/x.png"]["name"]) == (1_000_000, 10, "x.png")
    gone = spark.createDataFrame([("p", "/no/such.jpg")], "project_id string, path string")
    files = listing.scan(spark, str(tmp_path), "p").select("project_id", "path").union(gone)
    read = {os.path.basename(r["path"]): r for r in heads.heads(files, 4).collect()}
    assert read["x.png"]["head"] == b"no p" and read["such.jpg"]["head"] is None and "such" in read["such.jpg"]["error"]
    times = exif.capture_times(exif.read(heads.heads(files))).collect()
    assert [r["original_ms"] for r in times if r["original"]] == [1_782_843_572_000 - 9 * 3_600_000]
    assert listing.contents(spark, str(tmp_path)).count() == 3


def test_each_keeps_errors(spark):
    rows = spark.range(5).select(F.col("id").alias("x")).coalesce(1)
    work = lambda row: (time.sleep(3) if row["x"] == 1 else None) or 10 // (row["x"] - 2) * 10
    found = {r["x"]: (r["value"], r["error"]) for r in analysis.each(rows, work, T.LongType(), ("x",), 0.5).collect()}
    assert found[0] == (-50, None) and found[3] == (100, None)
    assert found[1][0] is None and "0.5 s" in found[1][1]
    assert found[2][0] is None and "ZeroDivision" in found[2][1]


def test_a_task_that_hangs_is_given_up(spark):
    rows = spark.range(6).select(F.col("id").alias("x")).coalesce(1)
    work = lambda row: time.sleep(2)
    assert analysis.each(rows.limit(2), work, T.LongType(), ("x",), 0.05, 2).where("error is not null").count() == 2
    with pytest.raises(Exception, match="took more than 0.05 s"):
        analysis.each(rows, work, T.LongType(), ("x",), 0.05, 2).collect()


def test_without_done(spark):
    schema = "id string, fingerprint_mtime bigint, fingerprint_size bigint"
    rows = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", None, None), ("d", None, None)], schema)
    done = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", None, None)], schema)
    assert sorted(r["id"] for r in analysis.without_done(rows, done, "id").collect()) == ["b", "d"]


def test_hashes_of_pixels(spark):
    flat, falling = [7] * 72, [9 - x for _ in range(8) for x in range(9)]
    rows = spark.createDataFrame([(1, flat), (2, falling), (3, falling[::-1]), (4, [1, 2])], "id int, red array<int>").withColumn("green", F.col("red")).withColumn("blue", F.col("red"))
    assert {r["id"]: r["d_hash"] for r in analysis.hashes_of_pixels(rows).collect()} == {1: "0" * 16, 2: "f" * 16, 3: "0" * 16, 4: None}


def test_orientation(spark):
    expected = {1: [1, 2, 3, 4, 5, 6], 2: [3, 2, 1, 6, 5, 4], 3: [6, 5, 4, 3, 2, 1], 4: [4, 5, 6, 1, 2, 3], 5: [1, 4, 2, 5, 3, 6], 6: [4, 1, 5, 2, 6, 3], 7: [6, 3, 5, 2, 4, 1], 8: [3, 6, 2, 5, 1, 4], 9: [1, 2, 3, 4, 5, 6]}
    rows = spark.createDataFrame([(k, [1, 2, 3, 4, 5, 6]) for k in expected], "o int, g array<int>")
    assert {r["o"]: r["x"] for r in rows.select("o", analysis.oriented(F.col("g"), 3, 2, F.col("o")).alias("x")).collect()} == expected


def test_rating_in_jpeg(spark):
    data = jpeg(tiff())
    once = export.rated_jpeg(data, 3)
    twice = export.rated_jpeg(once, 0)
    assert b"<xmp:Rating>3<" in once and b"<xmp:Rating>0<" in twice and b"<xmp:Rating>3<" not in twice
    assert once.endswith(b"pixels\xff\xd9") and once.index(b"Exif\0\0") < once.index(b"xap/1.0")
    files = spark.createDataFrame([("a", data, 5), ("b", b"no jpeg", 1), ("c", None, None)], "id string, content binary, rating int")
    out = {r["id"]: r for r in export.with_ratings(files).collect()}
    assert b"<xmp:Rating>5<" in out["a"]["content"] and out["b"]["content"] is None and out["c"]["error"]


def test_rating_needs_a_whole_file():
    """Cut off in its pixels with a whole thumbnail inside, lengths of 0 and 1, a segment beyond the end, no start."""
    thumb = b"\xff\xd8tiny\xff\xd9"
    whole = jpeg(tiff() + thumb)
    assert export.rated_jpeg(whole, 2).endswith(b"pixels\xff\xd9")
    for bad in (whole[:-2], whole[:-5], whole + b"x", b"\xff\xd8\xff\xe0\0\0\xff\xd9", b"\xff\xd8\xff\xe0\0\1\xff\xd9", b"\xff\xd8\xff\xe0\xff\xff\xff\xd9", b"\xff\xd8", b"", whole[2:]):
        with pytest.raises(ValueError, match="JPEG|cut off"):
            export.rated_jpeg(bad, 2)


def test_rating_stands_after_the_last_app1():
    segment = lambda marker, body: bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body
    pixels = b"\xff\xda\0\2pixels\xff\xd9"
    app1, app2, again = segment(0xE1, b"Exif\0\0one"), segment(0xE2, b"profile"), segment(0xE1, b"Exif\0\0two")
    old = segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0old")
    packet = export.rated_jpeg(b"\xff\xd8" + pixels, 4)[2 : -len(pixels)]
    assert export.rated_jpeg(b"\xff\xd8" + app1 + app2 + again + old + pixels, 4) == b"\xff\xd8" + app1 + app2 + again + packet + pixels
    assert export.rated_jpeg(b"\xff\xd8" + old + app1 + app2 + pixels, 4) == b"\xff\xd8" + app1 + packet + app2 + pixels
    assert export.rated_jpeg(b"\xff\xd8" + app2 + pixels, 4) == b"\xff\xd8" + packet + app2 + pixels


def test_layout_and_archives(spark):
    names = [("1", "a.jpg"), ("2", "a.jpg"), ("3", "a (2).jpg"), ("4", "a.jpg"), ("5", "noext"), ("6", "noext"), ("7", "a (2).jpg")]
    files = spark.createDataFrame([("p", 5, n, i, i, b"x" * 10, 0) for i, n in names] + [("p", 4, "a.jpg", "8", "8", b"y", 1_700_000_000_000)], "project_id string, rating int, name string, relative_path string, id string, content binary, modified_ms bigint")
    placed = {r["id"]: r["target"] for r in export.layout(files).collect()}
    assert len(set(placed.values())) == 8
    assert placed["1"] == "star-5/a.jpg" and placed["3"] == "star-5/a (2).jpg" and placed["8"] == "star-4/a.jpg" and placed["6"] == "star-5/noext (2)"
    shards = export.zip_shards(export.layout(files), 30).collect()
    found = {}
    for r in shards:
        with zipfile.ZipFile(BytesIO(r["archive"])) as z:
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            found |= {n: z.read(n) for n in z.namelist()}
    assert set(found) == set(placed.values()) and found["star-4/a.jpg"] == b"y"


@pytest.mark.parametrize("move", [False, True])
def test_place_files(spark, tmp_path, move):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(b"a")
    files = spark.createDataFrame([("1", f"{tmp_path}/in/a.jpg", "star-5/a.jpg"), ("2", f"{tmp_path}/in/no.jpg", "star-5/no.jpg"), ("3", f"{tmp_path}/in/a.jpg/x", "star-1\0/x")], "id string, path string, target string")
    outcomes = export.place_files(files.where("id < '3'"), f"{tmp_path}/out", f"{tmp_path}/in", move).collect()
    assert {r["id"]: r["status"] for r in outcomes} == {"1": "processed", "2": "skipped"}
    assert (tmp_path / "out/star-5/a.jpg").read_bytes() == b"a" and (tmp_path / "in/a.jpg").exists() != move
    rows = spark.createDataFrame(outcomes, "id string, status string, error string")
    report = export.report(rows).first()
    assert (report["processed"], report["skipped"], report["failed"], report["errors"]) == (1, 1, 0, [])
    photos = spark.createDataFrame([("1", False), ("2", False)], "id string, is_missing boolean")
    assert {r["id"]: r["is_missing"] for r in export.after_move(photos, rows).collect()} == {"1": True, "2": False}
    with pytest.raises(ValueError, match="source folder"):
        export.place_files(files, f"{tmp_path}/in/out", f"{tmp_path}/in")


def test_marks_and_headers():
    block = tiff("<", "2026:06:30 18:19:32")
    exif_segment = b"\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block
    broken = b"\xff\xe1\x00\x0cExif\0\0abcd"
    end = b"\xff\xda\x00\x02pixels\xff\xd9"
    cases = {
        "a marker without a length": b"\xff\xd8\xff\x01" + exif_segment + end,
        "a mark outside a segment": b"\xff\xd8\xff\xe0\x00\x04ab" + end + b"Exif\0\0" + block,
        "a broken header before the good one": b"\xff\xd8" + broken + exif_segment + end,
        "a broken length": b"\xff\xd8\xff\xe0\x00\x01" + exif_segment + end,
        "another kind of file": b"....ftypheic" + b"Exif\0\0abcd" + b"Exif\0\0" + block,
    }
    for name, data in cases.items():
        assert exif.fields(data)["datetime"] == "2026:06:30 18:19:32", name
    assert exif.tiff_start(b"\xff\xd8" + broken + end) is None and exif.tiff_start(b"Exif\0\0") is None and exif.tiff_start(block) == 0


def test_whole_read_where_the_head_is_not_enough(spark, tmp_path):
    block, late = tiff("<", "2026:06:30 18:19:32"), tiff("<", "2026:06:30 18:19:32", thumbnail=b"t" * 3000)
    filler = [(0xE2, b"x" * 5000)]
    far = jpeg(None, filler)[:-2] + b"Exif\0\0" + block + b"\xff\xd9"
    files = {"near": jpeg(block) + b"z" * 9000, "far": far, "thumbnail": jpeg(late) + b"z" * 100, "none": jpeg(None, filler)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(str(tmp_path / n),) for n in files], "path string")
    got = {os.path.basename(r["path"]): bytes(r["head"]) for r in heads.heads(rows, 2000, enough=exif.enough).collect()}
    assert len(got["near"]) == 2000 and all(got[n] == files[n] for n in ("far", "thumbnail", "none"))
    fields = {os.path.basename(r["path"]): r for r in exif.read(heads.heads(rows, 2000, enough=exif.enough)).collect()}
    assert fields["far"]["datetime"] == "2026:06:30 18:19:32" and fields["thumbnail"]["thumbnail_length"] == 3000 and fields["none"]["datetime"] is None


def png(rows):
    """A PNG file of rows of (red, green, blue)."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoded_pictures(spark, tmp_path):
    rising = [[(10 * x, 10 * x, 10 * x) for x in range(9)] for _ in range(8)]
    falling = [[p for p in row[::-1]] for row in rising]
    scaled = [[p for p in row for _ in range(10)] for row in falling for _ in range(20)]
    red = [[(255, 0, 0), (0, 0, 255)] * 4 + [(255, 0, 0)] for _ in range(8)]
    for name, rows in {"rising": rising, "falling": falling, "scaled": scaled, "red": red}.items():
        (tmp_path / f"{name}.png").write_bytes(png(rows))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    pictures = images.decoded(spark, str(tmp_path))
    out = images.hashed(pictures)
    found = {os.path.basename(r["path"]): (r["d_hash"], r["thumbnail_width"], r["thumbnail_height"], r["error"]) for r in out.collect()}
    assert found == {
        "rising.png": ("0" * 16, 9, 8, None), "falling.png": ("f" * 16, 9, 8, None), "scaled.png": ("f" * 16, 90, 160, None), "red.png": ("5" * 16, 9, 8, None), "broken.png": (None, None, None, "can't be decoded"),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_with_cache(spark):
    schema = "project_id string, id string, is_missing boolean, fingerprint_mtime bigint, fingerprint_size bigint, thumbnail_mtime bigint, thumbnail_size bigint, thumbnail_version int, thumbnail_path string, d_hash_version int, d_hash string"
    rows = [
        ("p", "hit", False, 1, 1, 1, 1, 2, "t", 2, "0"), ("p", "old hash", False, 1, 1, 1, 1, 2, "t", 1, "0"), ("p", "no hash", False, 1, 1, 1, 1, 2, "t", None, None), ("p", "changed", False, 2, 1, 1, 1, 2, "t", 2, "0"),
        ("p", "old thumbnail", False, 1, 1, 1, 1, 1, "t", 2, "0"), ("p", "fails", False, None, None, None, None, None, None, None, None), ("p", "missing", True, 1, 1, 1, 1, 2, "t", 1, "0"),
    ]
    photos = spark.createDataFrame(rows, schema)

    def regenerate(row):
        if row["id"] == "fails":
            raise ValueError("no file")
        return f"new {row['id']}"

    out = {r["id"]: (r["outcome"], r["value"], r["error"]) for r in analysis.with_cache(photos, lambda row: "rehashed", regenerate, T.StringType()).collect()}
    assert out == {
        "hit": ("hit", None, None), "old hash": ("rehash", "rehashed", None), "no hash": ("rehash", "rehashed", None), "changed": ("regenerate", "new changed", None),
        "old thumbnail": ("regenerate", "new old thumbnail", None), "fails": ("failed", None, "ValueError: no file"),
    }
    assert analysis.with_cache(photos.limit(0), regenerate, regenerate, T.StringType()).count() == 0
