"""Operators that SQL cannot express, against brute force or by their laws."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.operators import blocks, corpus, histograms, rate_distortion, stencils
from pixelloom.sources.fixtures import hidden_rgb, image


def test_pixel_identity(spark):
    rows = hidden_rgb(spark).orderBy("pos").collect()
    raw = (16).to_bytes(4, "little") * 2 + b"".join(bytes([r.r, r.g, r.b, r.a]) for r in rows)
    found = corpus.pixel_identity(hidden_rgb(spark)).first()
    assert found.sha256 == hashlib.sha256(raw).hexdigest() and found.has_alpha


def test_prediction_is_invertible(spark):
    px = image(spark, "alpha128").where("y < 8").cache()
    res = {(r.mode, r.pos): r for r in stencils.residuals(px, 128, [1, 2]).collect()}
    source = {r.pos: r for r in px.collect()}
    for pos, s in source.items():
        if s.x and s.y:
            assert (res[1, pos].g + source[pos - 1].g) % 256 == s.g
            assert (res[2, pos].g + source[pos - 128].g) % 256 == s.g


@pytest.mark.parametrize("seed", range(5))
def test_code_lengths(seed):
    rng = random.Random(seed)
    counts = {s: rng.randint(1, 1000) ** rng.randint(1, 3) for s in rng.sample(range(280), rng.randint(2, 200))}
    lengths = histograms.code_lengths(counts)
    assert max(lengths.values()) <= 15 and sum(2.0 ** -n for n in lengths.values()) == 1


def test_code_lengths_are_limited():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    lengths = histograms.code_lengths(dict(enumerate(fibonacci)))
    assert max(lengths.values()) <= 15 and sum(2.0 ** -n for n in lengths.values()) <= 1


def test_canonical_codes_are_prefix_free(spark):
    df = spark.createDataFrame([("i", s, n) for s, n in enumerate([3, 3, 2, 2, 2])], "img string, symbol int, length int")
    codes = [format(r.code, f"0{r.length}b") for r in histograms.canonical_codes(df, "img").collect()]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_curve_reproduces_lines_and_integrals():
    c = rate_distortion.Curve(np.array([0.0, 1.0, 3.0, 4.0]), np.array([1.0, 3.0, 7.0, 9.0]))
    assert c.value(2.0) == pytest.approx(5.0) and c.integral(0.0, 4.0) == pytest.approx(20.0)
    assert c.value(4.5) is None


def test_curve_stays_monotone():
    x, y = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 0.1, 5, 5.1, 9])
    v = [rate_distortion.Curve(x, y).value(t) for t in np.linspace(0, 4, 200)]
    assert all(b >= a - 1e-12 for a, b in zip(v, v[1:]))


def test_equal_curves_do_not_differ():
    p = np.log(np.array([1.0, 2, 4, 8])), np.array([30.0, 33, 36, 39])
    assert rate_distortion.bd_rate(p, p) == pytest.approx(0) and rate_distortion.bd_quality(p, p) == pytest.approx(0)
    half = p[0] - np.log(2), p[1]
    assert rate_distortion.bd_rate(half, p) == pytest.approx(-50)
    assert rate_distortion.bd_rate((p[0][:3], p[1][:3]), p) is None


def test_interpolation_stays_inside(spark):
    pts = spark.createDataFrame([("f", float(x), float(x * x)) for x in range(5)], "fixture string, x double, y double")
    t = spark.createDataFrame([("f", 2.0), ("f", 9.0)], "fixture string, target double")
    got = {r.target: r.value for r in rate_distortion.interpolated(pts, t).collect()}
    assert got[2.0] == pytest.approx(4.0) and (got[9.0] is None or got[9.0] != got[9.0])


def test_transforms_round_trip(spark):
    rng = random.Random(1)
    rows = [([rng.randint(0, 255) for _ in range(16)],) for _ in range(50)]
    df = spark.createDataFrame(rows, "v array<int>").withColumn("p", F.array_repeat(F.lit(128), 16))
    df = df.withColumn("c", blocks.forward_dct(F.transform("v", lambda v: v - 128)))
    for r in df.select("v", blocks.inverse_dct(F.col("p"), F.col("c")).alias("back")).collect():
        assert max(abs(a - b) for a, b in zip(r.v, r.back)) <= 2
    w = df.withColumn("t", blocks.forward_wht(F.col("v"))).select("v", blocks.inverse_wht(F.col("t")).alias("back"))
    for r in w.collect():
        assert max(abs(a - b) for a, b in zip(r.v, r.back)) <= 2


def test_metric_delta(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (3.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(P.metric_delta(F.col("a"), F.col("b"))).collect()] == [0.0, None, 2.0]


def test_low32_product(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(32),) for _ in range(100)]
    for r in spark.createDataFrame(rows, "p long").select("p", P.low32_product(F.col("p"), 0x85EBCA6B).alias("h")).collect():
        assert r.h == r.p * 0x85EBCA6B & 0xFFFFFFFF


def test_unpremultiply(spark):
    df = spark.createDataFrame([(0, 0), (64, 128), (128, 128)], "c int, a int")
    assert [r[0] for r in df.select(P.unpremultiply(F.col("c"), F.col("a"))).collect()] == [0, 127, 255]
