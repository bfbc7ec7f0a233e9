"""Files and streams."""

import hashlib
import struct
import zlib

from pyspark.sql import functions as F

from pixelloom.functions import vp8l
from pixelloom.operators import images
from pixelloom.sources import images as source
from pixelloom.sources.fixtures import hidden_rgb
from pixelloom.streaming import encoding


def png(w, h, rgba):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    rows = b"".join(b"\0" + bytes(v for p in rgba[y * w : (y + 1) * w] for v in p) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_index(spark, tmp_path):
    px = [(x * 20, y * 30, 7, 0 if x == 1 else 255) for y in range(3) for x in range(4)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PNG").write_bytes(png(4, 3, px))
    (tmp_path / "sub" / "b.png").write_bytes(png(4, 3, px))
    (tmp_path / "note.txt").write_text("no image")
    assert source.files(spark, str(tmp_path)).groupBy("is_image").count().where("NOT is_image").first()["count"] == 1
    rows = source.index(spark, str(tmp_path / "sub")).collect()
    raw = (4).to_bytes(4, "little") + (3).to_bytes(4, "little") + bytes(v for p in px for v in p)
    assert rows[0].pixel_sha256 == hashlib.sha256(raw).hexdigest() and rows[0].has_alpha and (rows[0].width, rows[0].height) == (4, 3)
    assert source.kept(source.index(spark, str(tmp_path / "sub")), "all").count() == 1


def test_chroma_join(spark):
    luma = spark.createDataFrame([("i", x, y) for x in range(4) for y in range(4)], "img string, x int, y int")
    chroma = spark.createDataFrame([("i", x, y, 10 * x + y, 0) for x in range(2) for y in range(2)], "img string, cx int, cy int, cb int, cr int")
    assert all(r.cb == r.x // 2 * 10 + r.y // 2 for r in source.chroma_at(luma, chroma, 2, 2).collect())


def test_stream(spark, tmp_path):
    images.packed(hidden_rgb(spark)).withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).write.parquet(str(tmp_path / "in"))
    q = encoding.write(encoding.encoded(encoding.arrivals(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert vp8l.decode(dict(vp8l.chunks(r.webp))["VP8L"])[:2] == (16, 16)
    assert encoding.sizes_by_window(encoding.arrivals(spark, str(tmp_path / "in"))).isStreaming


def test_unreadable_files_are_named(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(2, 2, [(1, 2, 3, 4)] * 4))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing more")
    assert [r.img.rsplit("/", 1)[1] for r in source.unreadable(spark, str(tmp_path)).collect()] == ["bad.png"]
    assert [(r.r, r.g, r.b, r.a) for r in source.pixels(spark, str(tmp_path)).collect()] == [(1, 2, 3, 4)] * 4
