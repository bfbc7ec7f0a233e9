"""Neighbourhood operators on pixel tables. Each image is one window partition, ordered by linear position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P

MODES = range(14)


def _order():
    return Window.partitionBy("img").orderBy("pos")


def neighbours(px: DataFrame, width: int) -> DataFrame:
    """Adds left, top, top-right and top-left channels (l_, t_, tr_, tl_) for images of one width; the last column's top-right wraps to the next pixel of its own row's start."""
    for c in "rgba":
        for name, n in (("l", 1), ("t", width), ("tr", width - 1), ("tl", width + 1)):
            px = px.withColumn(f"{name}_{c}", F.lag(c, n).over(_order()))
    return px


def _average(a: Column, b: Column) -> Column:
    return P.div(a + b, 2)


def _clamp_half(a: Column, b: Column) -> Column:
    return P.clip(a + P.div(a - b, 2))


def predict(mode: Column, c: str) -> Column:
    """The prediction of channel c by a mode from 0 to 13, inside the image."""
    left, top, tr, tl = (F.col(f"{n}_{c}") for n in ("l", "t", "tr", "tl"))
    apart = lambda one: sum((F.abs(F.col(f"l_{k}") + F.col(f"t_{k}") - F.col(f"tl_{k}") - F.col(f"{one}_{k}")) for k in "argb"), F.lit(0))
    by_mode = [
        F.lit(255 if c == "a" else 0), left, top, tr, tl, _average(_average(left, tr), top), _average(left, tl), _average(left, top), _average(tl, top), _average(top, tr),
        _average(_average(left, tl), _average(top, tr)), F.when(apart("l") < apart("t"), left).otherwise(top), P.clip(left + top - tl), _clamp_half(_average(left, top), tl),
    ]
    out = F.when(mode == 0, by_mode[0])
    for m in MODES[1:]:
        out = out.when(mode == m, by_mode[m])
    first = F.when((F.col("x") == 0) & (F.col("y") == 0), 255 if c == "a" else 0)
    return first.when(F.col("y") == 0, left).when(F.col("x") == 0, top).otherwise(out)


def residuals(px: DataFrame, width: int, modes: list[int] | None = None) -> DataFrame:
    """Wrapped prediction residuals of every pixel in every mode: (img, mode, pos, r, g, b, a)."""
    n = neighbours(px, width).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes or MODES])))
    return n.select("img", "mode", "pos", "x", "y", *[P.wrap(F.col(c) - predict(F.col("mode"), c)).alias(c) for c in "rgba"])


def near_lossless(px: DataFrame, width: int, height: int, quality: int) -> DataFrame:
    """Passes from the coarsest step down; each reads the pass before. Small images and borders stay as they are."""
    bits = 0 if quality >= 100 else 5 - max(quality, 0) // 20
    if (width < 64 and height < 64) or height < 3:
        return px
    for b in range(bits, 0, -1):
        px = _one_pass(px, width, height, b)
    return px


def near_lossless_single(px: DataFrame, width: int, height: int, quality: int) -> DataFrame:
    """One pass at the coarsest step, for images too large for several."""
    bits = 0 if quality >= 100 else 5 - max(quality, 0) // 20
    return _one_pass(px, width, height, bits) if bits else px


def _one_pass(px: DataFrame, width: int, height: int, b: int) -> DataFrame:
    inside = (F.col("x") > 0) & (F.col("x") < width - 1) & (F.col("y") > 0) & (F.col("y") < height - 1)
    near = F.lit(True)
    for c in "rgb":
        for n in (F.lag(c, 1), F.lead(c, 1), F.lag(c, width), F.lead(c, width)):
            near = near & (F.abs(F.col(c) - n.over(_order())) < (1 << b))
    return px.withColumn("smooth", near).withColumns({c: F.when(inside & ~F.col("smooth"), P.near_lossless_value(F.col(c), b)).otherwise(F.col(c)) for c in "rgb"}).drop("smooth")


def cache_hits(px: DataFrame, bits: list[int]) -> DataFrame:
    """(img, bits, hits): pixels that equal the last pixel in their slot of a colour cache of 2^bits."""
    p = px.select("img", "pos", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    out = None
    for n in bits:
        w = Window.partitionBy("img", "slot").orderBy("pos")
        one = p.withColumn("slot", P.cache_slot(F.col("p"), n)).withColumn("hit", (F.lag("p").over(w) == F.col("p")).cast("int"))
        one = one.groupBy("img").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).select("img", F.lit(n).alias("bits"), "hits")
        out = one if out is None else out.unionByName(one)
    return out


def runs(px: DataFrame, least: int = 4) -> DataFrame:
    """(img, start, length, p): runs of equal pixels of at least `least`, by gaps and islands."""
    p = px.select("img", "pos", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    p = p.withColumn("new", F.when(F.lag("p").over(_order()) == F.col("p"), 0).otherwise(1)).withColumn("run", F.sum("new").over(_order()))
    return p.groupBy("img", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.min("p").alias("p")).where(F.col("length") >= least).drop("run")


def offset_matches(px: DataFrame, width: int) -> DataFrame:
    """(img, distance, matches, longest): how often and how long pixels repeat at distances 1, w-1, w, w+1."""
    p = px.select("img", "pos", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    out = None
    for d in (1, width - 1, width, width + 1):
        m = p.withColumn("same", (F.lag("p", d).over(_order()) == F.col("p")) & F.lag("p", d).over(_order()).isNotNull())
        m = m.withColumn("island", F.sum(F.when(F.coalesce("same", F.lit(False)), 0).otherwise(1)).over(_order())).where("same")
        m = m.groupBy("img", "island").count().groupBy("img").agg(F.sum("count").alias("matches"), F.max("count").alias("longest")).select("img", F.lit(d).cast("long").alias("distance"), "matches", "longest")
        out = m if out is None else out.unionByName(m)
    return out


def chroma_planes(px: DataFrame, width: int, height: int) -> DataFrame:
    """(img, cx, cy, cb, cr): chroma at half size. Flat 2x2 cells are averaged; others take a 4x4 window with weights 1 2 2 1, edges clamped."""
    cb, cr = P.chroma(F.col("r"), F.col("g"), F.col("b"))
    c = px.select("img", "x", "y", cb.alias("cb"), cr.alias("cr"))
    # a pixel serves the cells whose 4x4 window holds it, clamped copies included
    cells = lambda v, n: F.explode(F.expr(f"sequence(greatest(CAST({v} DIV 2 AS INT) - 1, 0), least(CAST({v} DIV 2 AS INT) + 1, {(n + 1) // 2 - 1}))"))
    sx = c.select("*", cells("x", width).alias("cx")).select("*", F.explode(F.expr("sequence(-1, 2)")).alias("ox")).where(f"least(greatest(cx * 2 + ox, 0), {width - 1}) = x")
    sy = sx.select("*", cells("y", height).alias("cy")).select("*", F.explode(F.expr("sequence(-1, 2)")).alias("oy")).where(f"least(greatest(cy * 2 + oy, 0), {height - 1}) = y")
    weight = F.expr("(CASE WHEN ox IN (0, 1) THEN 2 ELSE 1 END) * (CASE WHEN oy IN (0, 1) THEN 2 ELSE 1 END)")
    inner = F.col("ox").isin(0, 1) & F.col("oy").isin(0, 1)
    g = sy.withColumn("w", weight).withColumn("inner", inner).groupBy("img", "cx", "cy").agg(*[
        x for k in ("cb", "cr") for x in (F.sum(F.col(k) * F.col("w")).alias(f"{k}_w"), F.sum(F.when(F.col("inner"), F.col(k))).alias(f"{k}_s"), (F.max(F.when(F.col("inner"), F.col(k))) - F.min(F.when(F.col("inner"), F.col(k)))).alias(f"{k}_d"))
    ])
    pick = lambda k: F.when(F.col(f"{k}_d") <= 16, P.div(F.col(f"{k}_s") + 2, 4)).otherwise(P.div(F.col(f"{k}_w") + 18, 36)).alias(k)
    return g.select("img", "cx", "cy", pick("cb"), pick("cr"))
