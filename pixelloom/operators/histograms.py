"""Symbol histograms, their entropy, and prefix code lengths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P


def subtract_green(px: DataFrame) -> DataFrame:
    return px.withColumns({"r": P.wrap(F.col("r") - F.col("g")), "b": P.wrap(F.col("b") - F.col("g"))})


def channel_counts(px: DataFrame, *by: str) -> DataFrame:
    """(by..., channel, symbol, n)."""
    long = px.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("int").alias("symbol")) for c in "rgba"])).alias("s")).select(*by, "s.channel", "s.symbol")
    return long.groupBy(*by, "channel", "symbol").agg(F.count("*").alias("n"))


def entropy(n: Column) -> Column:
    """Unnormalised: N log2 N - sum n log2 n; 0 below 2."""
    total = F.sum(n)
    return F.when(total < 2, 0.0).otherwise(total * F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))))


def channel_entropy(px: DataFrame, *by: str) -> DataFrame:
    return channel_counts(px, *by).groupBy(*by, "channel").agg(F.sum("n").alias("pixels"), F.count("*").alias("symbols"), F.round(entropy(F.col("n")), 4).alias("entropy"))


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Prefix code lengths; equal weights merge in the order of their smallest symbol. Too deep a tree gives way to the best code within the limit."""
    live = sorted(s for s, n in counts.items() if n > 0)
    if len(live) < 2:
        return dict.fromkeys(live, 1)
    heap = [(counts[s], s, [s]) for s in live]
    heapq.heapify(heap)
    depth = dict.fromkeys(live, 0)
    while len(heap) > 1:
        (n, a, x), (m, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (n + m, min(a, b), x + y))
    return depth if max(depth.values()) <= most else limited_lengths({s: counts[s] for s in live}, most)


def limited_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """The lengths of least total cost of which none is over `most`, by package merge: a symbol's length is the number of chosen packages that hold it."""
    coins = sorted((n, [s]) for s, n in counts.items())
    packages: list[tuple[int, list[int]]] = []
    for _ in range(most):
        level = sorted([*coins, *packages])
        packages = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) for i in range(0, len(level) - 1, 2)]
    lengths = dict.fromkeys(counts, 0)
    for _, held in packages[: len(counts) - 1]:
        for s in held:
            lengths[s] += 1
    return lengths


def canonical_codes(lengths: DataFrame, *by: str) -> DataFrame:
    """Adds the canonical code of each (by..., symbol, length): first by length, then by symbol."""
    order = Window.partitionBy(*by).orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.expr("shiftleft(1L, 15 - length)")).over(order), F.lit(0).cast("long"))
    return lengths.withColumn("code", F.call_function("shiftright", used, F.lit(15) - F.col("length")))


def huffman(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., symbol, n, length): code lengths of each histogram; a histogram has at most a few hundred symbols."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        lengths = code_lengths(dict(zip(t["symbol"].astype(int), t["n"].astype(int))))
        return t.assign(length=[lengths[int(s)] for s in t["symbol"]])

    fields = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in (*by, "symbol", "n"))
    return counts.select(*by, "symbol", "n").groupBy(*by).applyInPandas(one, f"{fields}, length int")


def data_bits(lengths: DataFrame, *by: str) -> DataFrame:
    return lengths.groupBy(*by).agg(F.sum(F.col("n") * F.col("length")).alias("bits"))


def estimate_colour(px: DataFrame, *by: str) -> DataFrame:
    """Least-squares coefficients (in 1/32) that predict red from green, and blue from green and red."""
    s = lambda c: P.signed(F.col(c)).cast("double")
    m = px.groupBy(*by).agg(*[F.sum(s(x) * s(y)).alias(x + y) for x, y in ("gg", "rr", "gr", "gb", "rb")])
    byte = lambda v: P.clip(F.round(v).cast("int"), -128, 127)
    det = F.col("gg") * F.col("rr") - F.col("gr") * F.col("gr")
    solid = F.abs(det) > 1e-9
    safe = F.when(solid, det).otherwise(1.0)
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    return m.select(
        *by,
        byte(F.col("gr") * 32 / one("gg")).alias("green_to_red"),
        F.when(solid, byte((F.col("gb") * F.col("rr") - F.col("rb") * F.col("gr")) * 32 / safe)).when((F.col("gg") >= F.col("rr")) & (F.col("gg") > 0), byte(F.col("gb") * 32 / one("gg"))).otherwise(0).alias("green_to_blue"),
        F.when(solid, byte((F.col("rb") * F.col("gg") - F.col("gb") * F.col("gr")) * 32 / safe)).when((F.col("gg") >= F.col("rr")) & (F.col("gg") > 0), 0).when(F.col("rr") > 0, byte(F.col("rb") * 32 / one("rr"))).otherwise(0).alias("red_to_blue"),
    )


def apply_colour(px: DataFrame, elements: DataFrame, *by: str) -> DataFrame:
    """Residual red and blue after the elements' predictions; blue is predicted from the source's red."""
    j = px.join(elements, list(by))
    red = P.wrap(F.col("r") - P.colour_delta(F.col("green_to_red"), F.col("g")))
    blue = P.wrap(F.col("b") - P.colour_delta(F.col("green_to_blue"), F.col("g")) - P.colour_delta(F.col("red_to_blue"), F.col("r")))
    return j.withColumns({"r": red, "b": blue}).select(*px.columns)


def palette(px: DataFrame, most: int = 256) -> DataFrame:
    """(img, p, idx, colours): distinct colours of the images with at most `most`, numbered in order of value."""
    p = px.select("img", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p")).distinct()
    few = p.groupBy("img").agg(F.count("*").alias("colours")).where(F.col("colours") <= most)
    return p.join(few, "img").withColumn("idx", F.row_number().over(Window.partitionBy("img").orderBy("p")) - 1)


def packed_indexes(px: DataFrame, most: int = 256) -> DataFrame:
    """(img, y, px, packed): palette indexes, 1 to 8 to a byte."""
    t = palette(px, most)
    j = px.withColumn("p", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a"))).join(t, ["img", "p"])
    k = P.palette_width_bits(F.col("colours"))
    j = j.withColumn("k", k).withColumn("px", F.call_function("shiftright", F.col("x"), F.col("k"))).withColumn("sub", F.col("x") - F.call_function("shiftleft", F.col("px"), F.col("k")))
    width = F.call_function("shiftright", F.lit(8), F.col("k"))
    return j.groupBy("img", "y", "px").agg(F.sum(F.call_function("shiftleft", F.col("idx").cast("long"), (F.col("sub") * width).cast("int"))).alias("packed"))


def palette_deltas(px: DataFrame) -> DataFrame:
    """(img, idx, dr, dg, db, da): wrapped differences of neighbouring palette entries."""
    t = palette(px)
    w = Window.partitionBy("img").orderBy("idx")
    c = P.unpack(F.col("p"))
    before = {k: F.coalesce(F.lag(v).over(w), F.lit(0)) for k, v in c.items()}
    return t.select("img", "idx", *[P.wrap(c[k] - before[k]).alias(f"d{k}") for k in "rgba"])


def facts(px: DataFrame) -> DataFrame:
    """(img, pixels, total, colours, opaque, uniform): what one scan tells of an image."""
    p = px.withColumn("p", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")))
    return p.groupBy("img").agg(F.count("*").alias("pixels"), F.sum("p").alias("total"), F.count_distinct("p").alias("colours"), F.bool_and(F.col("a") == 255).alias("opaque"), (F.min("p") == F.max("p")).alias("uniform"))
