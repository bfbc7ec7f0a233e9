"""Tiles of an image: features, groups of alike tiles, colour elements found by descent, and the plan whose groups cost least.

A tile has at most a few thousand pixels and an image a few ten thousand tiles; those are the units that are worked on as arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.operators import histograms

CHANNELS = "rgba"


def tiled(px: DataFrame, size_bits: int) -> DataFrame:
    """px with tile, numbered by rows of tiles."""
    across = F.shiftright(F.col("width") + (1 << size_bits) - 1, size_bits)
    return px.withColumn("tile", (F.shiftright("y", size_bits) * across + F.shiftright("x", size_bits)).cast("int"))


def features(px: DataFrame, size_bits: int) -> DataFrame:
    """(img, tile, f): of each channel its entropy a pixel, its share of zeros, and its share of the most frequent value."""
    n = histograms.channel_counts(tiled(px, size_bits), "img", "tile")
    each = n.groupBy("img", "tile", "channel").agg(
        (histograms.entropy(F.col("n")) / F.sum("n")).alias("entropy"), (F.sum(F.when(F.col("symbol") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("zeros"), (F.max("n") / F.sum("n")).alias("most")
    )
    listed = F.array_sort(F.collect_list(F.struct("channel", F.array("entropy", "zeros", "most").alias("v"))))  # four a tile
    return each.groupBy("img", "tile").agg(F.flatten(F.transform(listed, lambda s: s["v"])).alias("f"))


def k_means(f: np.ndarray, groups: int, rounds: int = 8) -> np.ndarray:
    """Group of each row: centres start at rows evenly spaced by the sum of their features; the nearest centre wins, the first of equals."""
    span = f.max(axis=0) - f.min(axis=0)
    f = (f - f.min(axis=0)) / np.where(span > 0, span, 1)
    order = np.argsort(f.sum(axis=1), kind="stable")
    centres = f[order[np.linspace(0, len(f) - 1, min(groups, len(f))).astype(int)]]
    group = np.zeros(len(f), int)
    for _ in range(rounds):
        now = ((f[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (now == group).all() and _:
            break
        group = now
        centres = np.array([f[group == g].mean(axis=0) if (group == g).any() else c for g, c in enumerate(centres)])
    return group


def clustered(found: DataFrame, groups: int, rounds: int = 8) -> DataFrame:
    """(img, tile, grp): groups of tiles with alike features, at most so many an image."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("tile")
        return pd.DataFrame({"img": t["img"], "tile": t["tile"], "grp": k_means(np.array(t["f"].tolist(), float), groups, rounds).astype(np.int32)})

    return found.select("img", "tile", "f").groupBy("img").applyInPandas(one, "img string, tile int, grp int")


def group_cost(px: DataFrame, size_bits: int, assigned: DataFrame, header_bits: int = 400) -> DataFrame:
    """(img, groups, cost): entropies of all groups' channels, and a header for each group."""
    n = histograms.channel_counts(tiled(px, size_bits).join(assigned, ["img", "tile"]), "img", "grp")
    e = n.groupBy("img", "grp", "channel").agg(histograms.entropy(F.col("n")).alias("e"))
    return e.groupBy("img").agg(F.count_distinct("grp").alias("groups"), F.round(F.sum("e") + F.count_distinct("grp") * header_bits, 4).alias("cost"))


def entropy_plan(px: DataFrame, size_bits: list[int], groups: list[int]) -> DataFrame:
    """(img, size_bits, asked, groups, cost): of all tile sizes and numbers of groups the cheapest; then the larger tiles and the fewer groups."""
    tried = None
    for bits in size_bits:
        found = features(px, bits)
        for g in groups:
            c = group_cost(px, bits, clustered(found, g)).select("img", F.lit(bits).alias("size_bits"), F.lit(g).alias("asked"), "groups", "cost")
            tried = c if tried is None else tried.unionByName(c)
    best = tried.groupBy("img").agg(F.min(F.struct("cost", (-F.col("size_bits")).alias("b"), "asked", "groups")).alias("m"))
    return best.select("img", (-F.col("m.b")).alias("size_bits"), "m.asked", "m.groups", "m.cost")


def colour_bits(target: np.ndarray, source: np.ndarray, element: int) -> float:
    """Entropy of a channel less an element's share of another one."""
    signed = (source + 128) % 256 - 128
    n = np.bincount((target - (element * signed >> 5)) % 256, minlength=256)
    n = n[n > 0]
    return float((n * (np.log2(n.sum()) - np.log2(n))).sum())


def descended(cost, start: int = 0) -> int:
    """An element from -128 to 127 by steps of 32, 16, ... 1: each step is taken while it makes the cost less."""
    best, value = cost(start), start
    step = 32
    while step:
        moved = True
        while moved:
            moved = False
            for to in (value - step, value + step):
                if -128 <= to <= 127 and (c := cost(to)) < best:
                    best, value, moved = c, to, True
        step //= 2
    return value


def colour_elements(px: DataFrame, size_bits: int, samples: int = 1024) -> DataFrame:
    """(img, tile, green_to_red, green_to_blue, red_to_blue, saved): each tile's colour elements by descent, and the bits that they save on it.

    A tile of more pixels is judged by every so-manieth of them.
    """

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        t = t.iloc[:: max(1, len(t) // samples)]
        r, g, b = (t[c].to_numpy(np.int64) for c in "rgb")
        gr = descended(lambda e: colour_bits(r, g, e))
        gb = descended(lambda e: colour_bits(b, g, e))
        rest = (b - (gb * ((g + 128) % 256 - 128) >> 5)) % 256
        rb = descended(lambda e: colour_bits(rest, r, e))
        saved = colour_bits(r, g, 0) - colour_bits(r, g, gr) + colour_bits(b, g, 0) - colour_bits(rest, r, rb)
        return pd.DataFrame({"img": [t["img"].iloc[0]], "tile": [t["tile"].iloc[0]], "green_to_red": [gr], "green_to_blue": [gb], "red_to_blue": [rb], "saved": [round(saved, 4)]})

    cells = tiled(px, size_bits).select("img", "tile", "pos", "r", "g", "b")
    return cells.groupBy("img", "tile").applyInPandas(one, "img string, tile int, green_to_red int, green_to_blue int, red_to_blue int, saved double")


def near_lossless_planes(px: DataFrame) -> DataFrame:
    """(img, pos, y, cb, cr): full-range samples in limited range, as a decoder of photographs hands them over."""
    y, cb, cr = P.full_range_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return px.select("img", "pos", P.full_to_limited_luma(y).cast("int").alias("y"), P.full_to_limited_chroma(cb).cast("int").alias("cb"), P.full_to_limited_chroma(cr).cast("int").alias("cr"))
