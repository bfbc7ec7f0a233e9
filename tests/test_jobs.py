"""Cancelling, counting and reporting."""

import io
import json
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import images, jobs, options, reports, search
from pixelloom.sources import fixtures


def test_cancelling_stops_running_tasks(spark):
    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    c = jobs.Cancellation(spark)
    threading.Timer(3, c.cancel).start()
    began = time.time()
    with pytest.raises(jobs.Cancelled):
        c.run(lambda: spark.range(4).mapInArrow(slow, "id long").count())
    assert time.time() - began < 40
    with pytest.raises(jobs.Cancelled):
        c.run(lambda: 1)
    assert jobs.Cancellation(spark).run(lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        jobs.Cancellation(spark).run(lambda: 1 // 0)


def test_encoder_and_counters(spark, tmp_path):
    packed = images.packed(fixtures.hidden_rgb(spark))
    files = jobs.Encoder("fast").encode(packed, jobs.Cancellation(spark), str(tmp_path / "out"))
    plain = jobs.Encoder().encode(packed)
    assert files.count() == plain.count() == 1
    with jobs.counted(images.layout(files)) as (layouts, counters):
        total = search.layout_sum(layouts).first()
        assert counters()["files"] == 1 and counters()["bytes"] == total.bytes and counters()["literals"] == total.literals
    assert set(jobs.environment()) >= {"commit", "dirty", "system", "processors"}


def test_png_and_manifest(spark, tmp_path):
    px = fixtures.pixels(spark, ["flat128"]).unionByName(fixtures.hidden_rgb(spark))
    files = reports.png_files(images.packed(px))
    rows = {r.img: r for r in reports.manifest(files, px).collect()}
    for r in files.collect():
        data = bytes(r.png)
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and rows[r.img].bytes == len(data)
        at, raw = 8, b""
        while at < len(data):
            n, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
            raw += data[at + 8 : at + 8 + n] if name == b"IDAT" else b""
            at += 12 + n
        assert len(zlib.decompress(raw)) == r.height * (4 * r.width + 1)
    assert rows["hidden16"].has_alpha and not rows["flat128"].has_alpha
    reports.write_json(reports.manifest(files, px).drop("bytes").withColumn("note", F.lit(None).cast("string")), str(tmp_path / "report"))
    lines = [json.loads(x) for f in (tmp_path / "report").glob("*.json") for x in io.open(f)]
    assert len(lines) == 2 and all("note" in x for x in lines)


def test_report_of_equal_curves_is_zero(spark):
    rows = [(1, e, 0.5 * k, 30.0 + 2 * k) for e in "ab" for k in range(6)] + [(2, "a", 0.1, 3.0)]
    got = {r.fixture: r for r in reports.rate_distortion_report(spark.createDataFrame(rows, "fixture int, encoder string, log_rate double, quality double"), "a", "b").collect()}
    assert got[1].left_points == got[1].right_points == 6 and abs(got[1].bd_rate) < 1e-9 and len(got[1].matched_size) == 6
    assert all(abs(m.gain) < 1e-9 for m in got[1].matched_size) and all(abs(m.percent) < 1e-9 for m in got[1].matched_quality)
    assert got[2].right_points == 0 and got[2].matched_size is None


def test_fixture_lists(spark):
    assert fixtures.verification(spark).count() == 12
    assert fixtures.comparison(spark, hidden=True).select("img").distinct().count() == 7
    assert options.product(fixtures.verification(spark).select("img").distinct(), [75, 50], ["a", "b"]).count() == 28


def test_header_bytes(spark):
    h = spark.range(1).select(options.extended_header(F.lit(300), F.lit(5), F.lit(True), F.lit(False), F.lit(False), F.lit(True)).alias("h")).first().h
    assert bytes(h) == b"VP8X\x0a\0\0\0\x24\0\0\0\x2b\x01\0\x04\0\0"


def test_diffused_errors_stay_small(spark):
    df = spark.createDataFrame([(1, i, 10 * i % 17) for i in range(20)], "g int, ord int, value long")
    rows = sorted(search.error_diffused(df, 8, "g").collect(), key=lambda r: r.ord)
    assert abs(sum(r.level * 8 - r.value for r in rows)) <= 80 and len(rows) == 20
