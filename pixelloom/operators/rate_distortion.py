"""Matching and comparing rate-distortion samples of two encoders.

samples: (fixture, encoder, quality, bytes, ssim_db, mse, pixels, ns, has_alpha), ssim_db null for exact results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P


def sides(samples: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    names = [c for c in samples.columns if c not in ("fixture", "encoder")]
    of = lambda e, k: samples.where(F.col("encoder") == e).select("fixture", *[F.col(c).alias(f"{k}_{c}") for c in names])
    return of(left, "l"), of(right, "r")


def at_quality(samples: DataFrame, left: str, right: str) -> DataFrame:
    """Samples of both encoders at the same quality."""
    a, b = sides(samples, left, right)
    return a.join(b, (a["fixture"] == b["fixture"]) & (a["l_quality"] == b["r_quality"])).drop(b["fixture"])


def nearest(samples: DataFrame, left: str, right: str, by: str) -> DataFrame:
    """For every left sample the nearest right sample of its fixture: by 'size' (ties: quality distance), or 'quality' (ties: fewer bytes); then the lower quality.

    The right side is sorted into one array a fixture (a fixture has at most one sample a quality), so no pairs are written out.
    """
    a, b = sides(samples, left, right)
    fields = [c for c in b.columns if c != "fixture"]
    candidates = b.groupBy("fixture").agg(F.collect_list(F.struct(*fields)).alias("c"))
    size = lambda c: F.abs(c["r_bytes"] - F.col("l_bytes")).cast("double")
    quality = lambda c: P.quality_distance(F.col("l_ssim_db"), c["r_ssim_db"])
    keys = (lambda c: (size(c), quality(c))) if by == "size" else (lambda c: (quality(c), c["r_bytes"].cast("double")))
    ranked = F.transform("c", lambda c: F.struct(keys(c)[0].alias("k1"), keys(c)[1].alias("k2"), c["r_quality"].alias("k3"), c.alias("c")))
    j = a.join(candidates, "fixture").withColumn("best", F.array_min(F.transform(ranked, lambda r: F.struct(r["k1"], r["k2"], r["k3"], r["c"]["r_bytes"].alias("b"), r["c"]["r_ssim_db"].alias("s")))))
    return j.select("fixture", *[c for c in a.columns if c != "fixture"], F.col("best.k3").alias("r_quality"), F.col("best.b").alias("r_bytes"), F.col("best.s").alias("r_ssim_db"))


def with_deltas(matches: DataFrame) -> DataFrame:
    return matches.withColumns({
        "d_bytes": F.col("l_bytes") - F.col("r_bytes"), "d_percent": F.round(P.percent_delta(F.col("l_bytes"), F.col("r_bytes")), 6),
        "d_ssim_db": F.round(P.metric_delta(F.col("l_ssim_db"), F.col("r_ssim_db")), 6),
    })


def by_quality(samples: DataFrame, left: str, right: str) -> DataFrame:
    """One row a quality; PSNR comes from the mean squared error, never from a mean of PSNRs."""
    m = at_quality(samples, left, right)
    w = F.col("l_pixels")
    return m.groupBy("l_quality").agg(
        F.count("*").alias("fixtures"), F.sum("l_pixels").alias("pixels"), F.sum("l_bytes").alias("l_bytes"), F.sum("r_bytes").alias("r_bytes"),
        F.count_if(F.col("l_bytes") < F.col("r_bytes")).alias("l_smaller"), F.count_if(F.col("l_bytes") > F.col("r_bytes")).alias("r_smaller"), F.count_if(F.col("l_bytes") == F.col("r_bytes")).alias("equal"),
        F.round(P.psnr(F.avg("l_mse")), 6).alias("l_psnr"), F.round(P.psnr(F.avg("r_mse")), 6).alias("r_psnr"),
        F.round(P.psnr(F.sum(F.col("l_mse") * w) / F.sum(w)), 6).alias("l_psnr_weighted"), F.round(P.psnr(F.sum(F.col("r_mse") * w) / F.sum(w)), 6).alias("r_psnr_weighted"),
    ).withColumnRenamed("l_quality", "quality")


def pareto(points: DataFrame, *by: str) -> DataFrame:
    """Of (by..., rate, quality) the points that raise quality as rate rises; one a rate."""
    w = Window.partitionBy(*by).orderBy("rate")
    best = points.groupBy(*by, "rate").agg(F.max("quality").alias("quality"))
    before = F.max("quality").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("before", before).where("before IS NULL OR quality > before").drop("before")


class Curve:
    """Shape-preserving cubic through increasing x: weighted harmonic slopes inside, limited one-sided slopes at the ends."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        h, d = np.diff(self.x), np.diff(self.y) / np.diff(self.x)
        m = np.zeros(len(self.x))
        if len(d) == 1:
            m[:] = d[0]
        else:
            for i in range(1, len(d)):
                if d[i - 1] * d[i] > 0:
                    a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                    m[i] = (a + b) / (a / d[i - 1] + b / d[i])
            m[0], m[-1] = self._end(h[0], h[1], d[0], d[1]), self._end(h[-1], h[-2], d[-1], d[-2])
        self.h, self.m = h, m

    @staticmethod
    def _end(h0: float, h1: float, d0: float, d1: float) -> float:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    def value(self, at: float) -> float | None:
        if not self.x[0] <= at <= self.x[-1]:
            return None
        i = min(int(np.searchsorted(self.x, at, side="right")) - 1, len(self.h) - 1)
        t, h = (at - self.x[i]) / self.h[i], self.h[i]
        return float(self.y[i] * (2 * t**3 - 3 * t**2 + 1) + h * self.m[i] * (t**3 - 2 * t**2 + t) + self.y[i + 1] * (3 * t**2 - 2 * t**3) + h * self.m[i + 1] * (t**3 - t**2))

    def integral(self, lo: float, hi: float) -> float:
        total = 0.0
        for i, h in enumerate(self.h):
            a, b = max(lo, self.x[i]), min(hi, self.x[i + 1])
            if b > a:
                def anti(t: float) -> float:
                    return self.y[i] * (t**4 / 2 - t**3 + t) + h * self.m[i] * (t**4 / 4 - 2 * t**3 / 3 + t**2 / 2) + self.y[i + 1] * (t**3 - t**4 / 2) + h * self.m[i + 1] * (t**4 / 4 - t**3 / 3)
                total += h * (anti((b - self.x[i]) / h) - anti((a - self.x[i]) / h))
        return total


def _front(rate: np.ndarray, quality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((-quality, rate))
    r, q = [], []
    for i in order:
        if (not r or rate[i] != r[-1]) and (not q or quality[i] > q[-1]):
            r.append(rate[i])
            q.append(quality[i])
    return np.array(r), np.array(q)


def bd_rate(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float | None:
    """Mean rate difference in percent at equal quality of two (log rate, quality) point sets; needs 4 useful points each and an overlap."""
    (lr, lq), (rr, rq) = _front(*left), _front(*right)
    if len(lr) < 4 or len(rr) < 4 or (hi := min(lq[-1], rq[-1])) <= (lo := max(lq[0], rq[0])):
        return None
    mean = (Curve(lq, lr).integral(lo, hi) - Curve(rq, rr).integral(lo, hi)) / (hi - lo)
    return 100 * (math.exp(mean) - 1)


def bd_quality(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float | None:
    (lr, lq), (rr, rq) = _front(*left), _front(*right)
    if len(lr) < 4 or len(rr) < 4 or (hi := min(lr[-1], rr[-1])) <= (lo := max(lr[0], rr[0])):
        return None
    return (Curve(lr, lq).integral(lo, hi) - Curve(rr, rq).integral(lo, hi)) / (hi - lo)


def bjontegaard(points: DataFrame, left: str, right: str) -> DataFrame:
    """(fixture, bd_rate, bd_quality) from (fixture, encoder, log_rate, quality); a fixture has at most 100 points an encoder."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        of = lambda e: tuple(t.loc[t["encoder"] == e, c].to_numpy(float) for c in ("log_rate", "quality"))
        return pd.DataFrame({"fixture": [t["fixture"].iloc[0]], "bd_rate": [bd_rate(of(left), of(right))], "bd_quality": [bd_quality(of(left), of(right))]})

    kind = points.schema["fixture"].dataType.simpleString()
    return points.where("log_rate IS NOT NULL AND quality IS NOT NULL").groupBy("fixture").applyInPandas(one, f"fixture {kind}, bd_rate double, bd_quality double")


def interpolated(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(fixture, target, value): the curve through each fixture's (x, y) at its targets; no value outside."""

    def one(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("x", kind="stable").drop_duplicates("x")
        curve = Curve(p["x"].to_numpy(), p["y"].to_numpy()) if len(p) > 1 else None
        return pd.DataFrame({"fixture": t["fixture"], "target": t["target"], "value": [curve.value(v) if curve else None for v in t["target"]]}).astype({"value": float})

    kind = points.schema["fixture"].dataType.simpleString()
    return points.groupBy("fixture").cogroup(targets.groupBy("fixture")).applyInPandas(one, f"fixture {kind}, target double, value double")


def timing(runs: DataFrame, *by: str) -> DataFrame:
    """Integer median (mean of the middle two, rounded down from the lower) and integer mean of (by..., ns).

    Ranks come from counts of equal times summed in order, so no list of a group's runs is gathered.
    """
    counts = runs.groupBy(*by, "ns").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by)
    c = counts.withColumn("upto", F.sum("n").over(own.orderBy("ns"))).withColumn("runs", F.sum("n").over(own))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("ns")))
    g = c.groupBy(*by).agg(F.max("runs").alias("runs"), at(P.div(F.col("runs") + 1, 2)).alias("lower"), at(P.div(F.col("runs"), 2) + 1).alias("upper"), F.sum(F.col("ns") * F.col("n")).alias("total"))
    return g.select(*by, "runs", (F.col("lower") + P.div(F.col("upper") - F.col("lower"), 2)).alias("median_ns"), P.div(F.col("total"), F.col("runs")).alias("mean_ns"))
