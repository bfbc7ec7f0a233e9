"""How two versions of an image differ: errors, composites, and weighted structural similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P

#: Weights of the 7-tap window.
TAPS = (1, 2, 3, 4, 3, 2, 1)


def paired(source: DataFrame, decoded: DataFrame) -> DataFrame:
    """Source and decoded channels (s_, d_) of each pixel."""
    s = source.select("img", "pos", "x", "y", *[F.col(c).alias(f"s_{c}") for c in "rgba"])
    return s.join(decoded.select("img", "pos", *[F.col(c).alias(f"d_{c}") for c in "rgba"]), ["img", "pos"])


def measure(source: DataFrame, decoded: DataFrame) -> DataFrame:
    """One row an image: mean absolute and squared errors, PSNR (null when exact), composites over black, white and checks."""
    p = paired(source, decoded)
    sq = lambda v: (v * v).cast("long")
    d = {c: F.col(f"d_{c}") - F.col(f"s_{c}") for c in "rgba"}
    ys, yd = (P.full_range_ycbcr(*[F.col(f"{k}_{c}") for c in "rgb"]) for k in "sd")
    checker = F.when((F.shiftright("x", 3) + F.shiftright("y", 3)) % 2 != 0, 255).otherwise(0)
    comp = lambda bg: sum((sq(P.composite(F.col(f"d_{c}"), F.col("d_a"), bg) - P.composite(F.col(f"s_{c}"), F.col("s_a"), bg)) for c in "rgb"), F.lit(0))
    m = p.groupBy("img").agg(
        F.count("*").alias("n"), F.sum(F.abs(d["r"]) + F.abs(d["g"]) + F.abs(d["b"])).alias("abs"), F.sum(sq(d["r"]) + sq(d["g"]) + sq(d["b"])).alias("sq"),
        F.sum(sq(yd[0] - ys[0])).alias("ysq"), F.sum(sq(yd[1] - ys[1]) + sq(yd[2] - ys[2])).alias("uvsq"), F.sum(F.abs(d["a"])).alias("aabs"),
        F.sum(comp(0)).alias("black"), F.sum(comp(255)).alias("white"), F.sum(comp(checker)).alias("checker"),
        F.bool_and((d["r"] == 0) & (d["g"] == 0) & (d["b"] == 0)).alias("rgb_exact"), F.bool_and(d["a"] == 0).alias("alpha_exact"),
    )
    per = lambda c, k: F.col(c) / (F.col("n") * k)
    r = lambda v: F.round(v, 6)
    out = m.select("img", r(per("abs", 3)).alias("rgb_mae"), r(per("aabs", 1)).alias("alpha_mae"), "rgb_exact", "alpha_exact", *[x for name, c, k in (("rgb", "sq", 3), ("y", "ysq", 1), ("uv", "uvsq", 2), ("black", "black", 3), ("white", "white", 3), ("checker", "checker", 3)) for x in (r(per(c, k)).alias(f"{name}_mse"), r(P.psnr(per(c, k))).alias(f"{name}_psnr"))])
    return out


def _taps(df: DataFrame, along: str, across: str, columns: list[str]) -> DataFrame:
    """Weighted sums over 7 neighbours along an axis, cut at the border; sums are exact integers."""
    w = Window.partitionBy("img", across).orderBy(along)
    near = lambda c, k: F.lag(c, -k).over(w) if k else F.col(c)
    return df.select("img", "x", "y", *[sum((F.coalesce(near(c, k - 3), F.lit(0).cast("long")) * t for k, t in enumerate(TAPS)), F.lit(0).cast("long")).alias(c) for c in columns])


def ssim(planes: DataFrame) -> DataFrame:
    """(img, ssim): mean structural similarity of (img, x, y, s, t) byte planes; the window separates into two passes of 7 taps."""
    m = planes.select("img", "x", "y", *[v.cast("long").alias(n) for n, v in (("w", F.lit(1)), ("s", F.col("s")), ("t", F.col("t")), ("ss", F.col("s") * F.col("s")), ("st", F.col("s") * F.col("t")), ("tt", F.col("t") * F.col("t")))])
    m = _taps(_taps(m, "x", "y", ["w", "s", "t", "ss", "st", "tt"]), "y", "x", ["w", "s", "t", "ss", "st", "tt"])
    return m.select("img", _score().alias("v")).groupBy("img").agg(F.round(F.avg("v"), 6).alias("ssim"))


def _score() -> Column:
    w, s, t, ss, st, tt = (F.col(c) for c in ("w", "s", "t", "ss", "st", "tt"))
    w2 = w * w
    sm, tm, product = s * s, t * t, s * t
    covariance = F.greatest(st * w - product, F.lit(0).cast("long"))
    above = F.shiftright(covariance * 2 + w2 * 60, 8)
    below = F.shiftright(ss * w - sm + tt * w - tm + w2 * 60, 8)
    score = ((product * 2 + w2 * 20).cast("double") * above.cast("double")) / ((sm + tm + w2 * 20).cast("double") * below.cast("double"))
    return F.when(sm + tm < w2 * 64, 1.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def luma_ssim(source: DataFrame, decoded: DataFrame) -> DataFrame:
    p = paired(source, decoded)
    s, t = (P.full_range_ycbcr(*[F.col(f"{k}_{c}") for c in "rgb"])[0] for k in "sd")
    return ssim(p.select("img", "x", "y", s.alias("s"), t.alias("t")))
