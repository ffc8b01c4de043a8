"""JPEG files in batches against Java's encoder and decoder, and what is stored of pictures."""

import os
import struct
import zlib

import numpy as np
import pytest
from framesift.operators import pictures
from framesift.sources import images, jpeg
from pyspark.sql import functions as F

from tests.core.test_sources import tiff


def made(height, width, seed, stretch=1):
    """A picture of waves with some noise."""
    rng, (y, x) = np.random.default_rng(seed), np.mgrid[:height, :width] / stretch
    waves = [128 + 70 * np.sin(x / (9 + seed % 17) + c) + 50 * np.cos(y / (12 + seed % 5) + 2 * c) for c in range(3)]
    return np.clip(np.stack(waves, axis=-1) + rng.normal(0, 4, (height, width, 3)), 0, 255).astype(np.uint8)


def scene(height, width, seed):
    """A picture of soft patches of any brightness, with some noise."""
    rng = np.random.default_rng(seed)
    coarse = rng.uniform(0, 255, (9, 11, 3))
    wide = np.stack([[np.interp(np.linspace(0, 10, width), np.arange(11), row[:, c]) for row in coarse] for c in range(3)], axis=-1)
    full = np.stack([np.stack([np.interp(np.linspace(0, 8, height), np.arange(9), wide[:, x, c]) for x in range(width)], axis=1) for c in range(3)], axis=-1)
    return np.clip(full + rng.normal(0, 4, full.shape), 0, 255).astype(np.uint8)


def png(rgb):
    """A PNG file without filters."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    rows = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def by_java(spark, rgb, kind="jpg"):
    """A picture as Java writes it: colour at half the size, codes of its own."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(png(rgb)))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


def means(rgb):
    """The mean of each whole block of 8 x 8."""
    h, w = rgb.shape[0] // 8, rgb.shape[1] // 8
    return rgb[: 8 * h, : 8 * w].reshape(h, 8, w, 8, 3).astype(float).mean((1, 3))


def with_exif(data, block):
    body = b"Exif\0\0" + block
    return data[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + data[2:]


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


@pytest.mark.parametrize("quality", [1, 30, 82, 100])
def test_round_trip(quality):
    """Sizes that are no multiples of 8, too; files differ less the better they are."""
    rows = [made(h, w, h) for h, w in ((1, 1), (8, 8), (7, 50), (61, 33), (100, 120))]
    files = [jpeg.encoded(p, quality) for p in rows]
    most = {1: 60, 30: 12, 82: 5, 100: 3}[quality]
    for p, whole, small in zip(rows, jpeg.decoded(files), jpeg.eighths(files)):
        assert whole.shape == p.shape and np.abs(whole.astype(int) - p).mean() < most
        assert small.shape == (-(-p.shape[0] // 8), -(-p.shape[1] // 8), 3)
        if min(p.shape[:2]) >= 8 and quality > 1:
            assert np.abs(means(whole) - small[: p.shape[0] // 8, : p.shape[1] // 8]).max() < 6


def test_files_of_another_encoder(spark):
    """Java's files: colour at half the size, so at an eighth a value of it is for four; brightness is that of the blocks, up to what is clipped."""
    rows = [made(64 + 8 * (i % 5), 80 + 16 * (i % 3), i) for i in range(12)] + [made(403, 605, 50)]
    files = [by_java(spark, p) for p in rows]
    for p, f, whole, small in zip(rows, files, jpeg.decoded(files), jpeg.eighths(files)):
        assert f != jpeg.encoded(p, 75) and whole.shape == p.shape
        assert np.abs(whole.astype(int) - p).mean() < 8
        assert np.abs((means(whole) - small[: p.shape[0] // 8, : p.shape[1] // 8]) @ [0.299, 0.587, 0.114]).mean() < 3


def test_long_streams_are_cut_into_lanes(spark, monkeypatch):
    """However a stream is cut, what is read is the same, in lanes of a few bytes, too, which have no time to fall into step."""
    rows = [made(160, 240, 7), made(90, 130, 8)]
    for files in ([jpeg.encoded(p, 90) for p in rows], [by_java(spark, p) for p in rows]):
        monkeypatch.setattr(jpeg, "LANE_BYTES", 1 << 30)
        whole = jpeg.eighths(files)
        for size in (17, 200, 1000):
            monkeypatch.setattr(jpeg, "LANE_BYTES", size)
            assert all((a == b).all() for a, b in zip(whole, jpeg.eighths(files)))
            assert all((a == b).all() for a, b in zip(jpeg.decoded(files), jpeg.decoded(files[::-1])[::-1]))


def test_restart_marks():
    """Streams with restart marks: differences begin anew after each."""
    picture = made(8, 64, 3)
    parts = [jpeg.encoded(picture[:, a : a + 16], 90) for a in range(0, 64, 16)]
    heads = [jpeg.header(p) for p in parts]
    whole = jpeg.encoded(picture, 90)
    body = b"".join(p[h.body : -2] + (bytes((0xFF, 0xD0 + i)) if i < 3 else b"") for i, (p, h) in enumerate(zip(parts, heads)))
    at = whole.index(b"\xff\xda")
    joined = whole[:at] + b"\xff\xdd\0\4\0\2" + whole[at : jpeg.header(whole).body] + body + b"\xff\xd9"
    assert jpeg.header(joined).interval == 2
    assert (jpeg.decoded([joined])[0] == jpeg.decoded([whole])[0]).all()
    assert jpeg.eighths([joined[: joined.index(b"\xff\xd2")] + b"\xff\xd9"]) == ["a part of the picture is missing"]


def test_broken_files():
    """Each is a reason of its own, and the others go on."""
    good = jpeg.encoded(made(40, 40, 1), 82)
    body = jpeg.header(good).body
    bad = [b"", b"text", good[:20], good[: body + 30] + b"\xff\xd9", good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xdb", b"\xff\xfe"), good[:body]]
    found = jpeg.eighths([*bad, good])
    assert [type(x) for x in found] == [str] * len(bad) + [np.ndarray]
    assert (found[-1] == jpeg.eighths([good])[0]).all()


def test_eighths_hash_like_whole_pictures(spark, tmp_path):
    """A hundred files: the hash at an eighth of the size is as near to that of Spark's own decoder as the published figures (mean 1.69, most 5 of 64 bits) allow."""
    for i in range(100):
        (tmp_path / f"{i:03}.jpg").write_bytes(by_java(spark, scene(240 + 8 * (i % 7), 320 + 16 * (i % 5), i)))
    pixels = pictures.from_pixels(images.decoded(spark, str(tmp_path)).drop("error").withColumn("orientation", F.lit(1)))
    whole = {r["path"]: r["d_hash"] for r in pictures.hashed(pixels).collect()}
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content", F.lit(None).cast("int").alias("orientation"))
    stored = pictures.from_eighths(files)
    found = {r["path"]: r["d_hash"] for r in pictures.hashed(stored).collect()}
    far = [distance(found[p], whole[p]) for p in whole]
    assert len(far) == 100 and sum(far) / 100 <= 1.69 and max(far) <= 5, far


def test_stored_pictures_are_read_by_spark(spark, tmp_path):
    """Spark's reader decodes what was written, and sees the same pixels."""
    for i, (h, w) in enumerate(((300, 500), (64, 64), (1200, 900))):
        small = pictures.fitted(made(h, w, i), 256)
        assert max(small.shape[:2]) == min(256, max(h, w))
        (tmp_path / f"{i}.jpg").write_bytes(jpeg.encoded(small, 82))
    rows = images.decoded(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and not [r for r in rows if r["error"]]
    for r in rows:
        with open(r["path"], "rb") as f:
            own = jpeg.decoded([f.read()])[0]
        pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)[:, :, ::-1]
        assert np.abs(pixels.astype(int) - own).max() <= 4


def test_ladder(spark, tmp_path):
    """Each file is read by the first rung that can; fresh hashes and those of the stored bytes agree; pictures are upright."""
    picture = made(480, 640, 4, 5)
    thumb = jpeg.encoded(pictures.fitted(picture, 160), 82)
    tiny = jpeg.encoded(pictures.fitted(picture, 60), 82)
    body = jpeg.encoded(picture, 90)
    files = {
        "thumb.jpg": with_exif(body, tiff(thumbnail=thumb, datetime="2024:01:01 00:00:00")), "tiny.jpg": with_exif(body, tiff(thumbnail=tiny, datetime="2024:01:01 00:00:00")), "plain.jpg": body,
        "turned.jpg": with_exif(jpeg.encoded(np.rot90(picture), 90), tiff(orientation=6)), "whole.png": png(picture), "broken.jpg": body[:3000], "text.png": b"no picture",
        "only-head.jpg": with_exif(body, tiff(thumbnail=thumb, datetime="2024:01:01 00:00:00"))[:-2000],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "gone.jpg"]], "path string").repartition(3)
    found = {os.path.basename(r["path"]): r for r in pictures.ladder(spark, paths, str(tmp_path)).collect()}
    assert {n: r["source"] for n, r in found.items()} == {
        "thumb.jpg": "exif_thumbnail", "only-head.jpg": "exif_thumbnail", "tiny.jpg": "jpeg_scaled", "plain.jpg": "jpeg_scaled", "turned.jpg": "jpeg_scaled", "whole.png": "full_decode",
        "broken.jpg": None, "text.png": None, "gone.jpg": None,
    }
    assert all((r["error"] is None) == (r["source"] is not None) == (r["d_hash"] is not None) for r in found.values())
    assert found["turned.jpg"]["width"] > found["turned.jpg"]["height"]
    hashes = [r["d_hash"] for r in found.values() if r["d_hash"]]
    assert max(distance(hashes[0], h) for h in hashes) <= 5
    cached = spark.createDataFrame([(n, r["thumbnail"]) for n, r in found.items()], "path string, thumbnail binary")
    assert {r["path"]: r["d_hash"] for r in pictures.hashed(cached).collect()} == {n: r["d_hash"] for n, r in found.items()}
    for r in found.values():
        if r["thumbnail"]:
            assert max(r["width"], r["height"]) <= 256


def test_orientations(spark):
    """Turned as the grid of the catalogue's hashes is."""
    from framesift.operators.analysis import oriented

    cells = [[1, 2, 3], [4, 5, 6]]
    rgb = np.stack([np.array(cells)] * 3, axis=-1)
    rows = spark.createDataFrame([(o, sum(cells, [])) for o in range(10)], "o int, g array<int>")
    for r in rows.select("o", oriented(F.col("g"), 3, 2, F.col("o")).alias("x")).collect():
        assert pictures.upright(rgb, r["o"])[:, :, 0].ravel().tolist() == r["x"]


def test_display(spark):
    """Smaller than stored: from what is stored; larger: from the original; broken bytes: from the original; no bytes: an error."""
    original, stored = jpeg.encoded(made(300, 400, 5), 90), jpeg.encoded(pictures.fitted(made(300, 400, 6), 200), 82)
    rows = [("down", stored, 200, original, None, 100), ("same", stored, 200, None, None, 200), ("up", stored, 200, original, 6, 300), ("new", None, None, original, None, 1000), ("broken", stored[:50], 200, original, 1, 100), ("none", None, None, None, None, 100)]
    frame = spark.createDataFrame(rows, "path string, display binary, display_edge int, original binary, orientation int, edge int")
    found = {r["path"]: r for r in pictures.display(frame, F.col("edge")).collect()}
    assert {n: (r["origin"], r["display_edge"]) for n, r in found.items()} == {"down": ("stored", 100), "same": ("stored", 200), "up": ("original", 300), "new": ("original", 1000), "broken": ("original", 100), "none": (None, None)}
    sizes = {n: jpeg.header(r["display"]) for n, r in found.items() if r["display"]}
    assert {n: (h.width, h.height) for n, h in sizes.items()} == {"down": (100, 75), "same": (200, 150), "up": (225, 300), "new": (400, 300), "broken": (100, 75)}
    assert found["none"]["error"]


def test_display_size_in_bytes():
    """A picture of usual detail at 1024 pixels takes tens to some hundreds of kilobytes at quality 82, as published (87 KB)."""
    assert 30_000 < len(jpeg.encoded(made(768, 1024, 2), 82)) < 350_000


def test_display_job(spark, tmp_path):
    """From the backlog to the catalogue: stored pictures are reused, others made from the originals; a second run has nothing to do."""
    from framesift.operators import pages

    original = with_exif(jpeg.encoded(made(300, 400, 5), 90), tiff(orientation=6))
    for name in ("new", "up", "broken"):
        (tmp_path / f"{name}.jpg").write_bytes(original)
    (tmp_path / "bad.jpg").write_bytes(b"no picture")
    small = jpeg.encoded(pictures.fitted(made(300, 400, 6), 200), 82)
    rows = [("p", n, str(tmp_path / f"{n}.jpg"), path, edge, None, n == "missing") for n, path, edge in (("down", "d", 200), ("new", None, None), ("up", "d", 64), ("broken", "d", 200), ("bad", None, None), ("gone", None, None), ("done", "d", 128), ("missing", None, None))]
    photos = spark.createDataFrame(rows, "project_id string, id string, path string, display_path string, display_edge int, analysis_error string, is_missing boolean")
    stored = spark.createDataFrame([("p", "down", small), ("p", "broken", small[:99]), ("p", "up", small), ("p", "done", small)], "project_id string, id string, display binary")
    built = pictures.build_displays(photos, 128, stored)
    found = {r["id"]: r for r in built.collect()}
    assert {n: r["origin"] for n, r in found.items()} == {"down": "stored", "new": "original", "up": "original", "broken": "original", "bad": None, "gone": None}
    shape = jpeg.header(found["new"]["display"])
    assert (shape.width, shape.height) == (96, 128)  # upright
    after = pictures.write_displays(photos, built, "displays")
    state = {r["id"]: (r["display_path"], r["display_edge"], r["analysis_error"] is not None) for r in after.collect()}
    assert state["new"] == ("displays/new.jpg", 128, False) and state["bad"] == (None, None, True) and state["gone"][2] and state["done"] == ("d", 128, False)
    assert {r["id"] for r in pages.to_display(after, 128).collect()} == {"bad", "gone"}
