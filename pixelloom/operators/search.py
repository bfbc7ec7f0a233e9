"""Choosing among candidates: ranks, finalists, matches, caches, groups and palettes, as windows and aggregates.

Every group here is an image, a tile or a position, so windows are cut by it; what is compared with everything is a column of the same row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.functions import vp8l

#: Fixed value of the bitstream format: the largest first partition.
FIRST_PARTITION = (1 << 19) - 1


def candidate_rank(literal_bits: Column, potential: Column, zeros: Column) -> Column:
    """Bits of a candidate as literals, less what matches and zero pixels may save; never below 0."""
    return F.greatest(literal_bits - (potential * 8 + zeros), F.lit(0))


def with_ranks(candidates: DataFrame) -> DataFrame:
    """Adds local, distant and rank (the lesser) to (literal_bits, local_potential, distant_potential, zeros)."""
    of = lambda c: candidate_rank(F.col("literal_bits"), F.col(c), F.col("zeros"))
    return candidates.withColumns({"local": of("local_potential"), "distant": of("distant_potential")}).withColumn("rank", F.least("local", "distant"))


def frontier(ranked: DataFrame, *by: str) -> DataFrame:
    """Of each family the candidate with the best local rank and, of the others, the one with the best distant rank; the first of equals."""
    own = Window.partitionBy(*by, "family")
    first = ranked.withColumn("local_place", F.row_number().over(own.orderBy("local", "ord")))
    rest = first.withColumn("distant_place", F.row_number().over(own.orderBy(F.col("local_place") == 1, "distant", "ord")))
    return rest.where("local_place = 1 OR distant_place = 1").drop("local_place", "distant_place")


def reservoir(ranked: DataFrame, limit: int, *by: str) -> DataFrame:
    """At most `limit` of each image's candidates: the worst rank goes first, from families with several, and never family 0 before others."""
    family = Window.partitionBy(*by, "family")
    spare = ranked.withColumn("spare", F.row_number().over(family.orderBy("rank", "ord")) > 1).withColumn("other", F.col("family") != 0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("spare", "other", "rank", "ord"))
    return spare.withColumn("place", place).where(F.col("place") <= limit).drop("spare", "other", "place")


def exact_finalists(scored: DataFrame, limit: int, *by: str) -> DataFrame:
    """The candidates with the fewest bits, and the best plain predictor if its screened cost beats the last of them; adds force_cache."""
    place = scored.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("bits", "ord")))
    plain = Window.partitionBy(*by, "predictor").orderBy("bits", "ord")
    last = F.max(F.when(F.col("place") <= limit, F.col("bits"))).over(Window.partitionBy(*by))
    p = place.withColumn("best_plain", F.col("predictor") & (F.row_number().over(plain) == 1)).withColumn("last", last)
    kept = p.where((F.col("place") <= limit) | (F.col("best_plain") & (F.col("screened_bits") < F.col("last"))))
    return kept.withColumn("force_cache", F.col("best_plain")).drop("place", "best_plain", "last")


def refined_first(plans: DataFrame, limit: int, *by: str) -> DataFrame:
    """Adds refine: whether a plan is among the first by bits, ties in the order of the candidates."""
    return plans.withColumn("refine", F.row_number().over(Window.partitionBy(*by).orderBy("bits", "ord")) <= limit)


def unscored(candidates: DataFrame, scored: DataFrame, *key: str) -> DataFrame:
    return candidates.join(scored.select(*key).distinct(), list(key), "left_anti")


def candidate_key(*parts: Column) -> Column:
    """128 bits of a candidate's structure, as hex."""
    two = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)]
    return F.lower(F.concat(*two))


def first_of_each(df: DataFrame, key: list[str], ord_: str = "ord") -> DataFrame:
    """One row a key: the first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(ord_))).where("_n = 1").drop("_n")


def may_add_block_colour(kinds: Column) -> Column:
    """Whether a colour transform by blocks may follow a chain: none, a predictor, or subtract green and a predictor."""
    allowed = [F.array().cast("array<string>"), F.array(F.lit("predictor")), F.array(F.lit("subtract-green"), F.lit("predictor"))]
    return (kinds == allowed[0]) | (kinds == allowed[1]) | (kinds == allowed[2])


def partition_fits(size: Column, limit: int = FIRST_PARTITION) -> Column:
    return size <= limit


def match_score(length: Column, code: Column) -> Column:
    """Eight bits a pixel, less the extra bits of the length and the distance code."""
    return length * 8 - P.prefix_code(length)[1] - P.prefix_code(code)[1]


def top_matches(matches: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best matches of each position (by..., length, code): the longest of a code, then by score, length and code."""
    longest = matches.groupBy(*by, "code").agg(F.max("length").alias("length")).withColumn("score", match_score(F.col("length"), F.col("code")))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("length"), "code")
    return longest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def undominated(matches: DataFrame, *by: str) -> DataFrame:
    """Matches (by..., length, cost) that no other one beats: at least as long and cheaper, or as cheap and longer."""
    w = Window.partitionBy(*by).orderBy("cost")
    cheaper = F.max("length").over(w.rangeBetween(Window.unboundedPreceding, -1))
    equal = F.max("length").over(w.rangeBetween(0, 0))
    beaten = F.coalesce(cheaper >= F.col("length"), F.lit(False)) | (equal > F.col("length"))
    return matches.withColumn("beaten", beaten).where(~F.col("beaten")).drop("beaten")


def row_matches(px: DataFrame, value: str = "a") -> DataFrame:
    """(img, pos, length, code): the longest match of each value with the row above, at offsets from 7 to the right to 8 to the left; the lowest code of equals.

    A match ends with its row. Lengths come from the next place where the two rows differ, so nothing is compared twice.
    """
    codes = {x: i + 1 for i, (x, y) in enumerate(vp8l.NEAR) if y == 1 and -7 <= x <= 8}
    offsets = F.explode(F.array(*[F.struct(F.lit(x).alias("back"), F.lit(c).alias("code")) for x, c in sorted(codes.items())]))
    p = px.select("img", "width", "pos", "x", "y", F.col(value).alias("v")).withColumn("o", offsets).select("*", "o.back", "o.code").drop("o")
    above = px.select("img", (F.col("y") + 1).alias("y"), F.col("x").alias("at"), F.col(value).alias("u"))
    both = p.withColumn("at", F.col("x") - F.col("back")).join(above, ["img", "y", "at"], "left")
    line = Window.partitionBy("img", "y", "back").orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    end = F.min(F.when(~F.col("v").eqNullSafe(F.col("u")), F.col("x"))).over(line)
    m = both.withColumn("length", F.coalesce(end, F.col("width").cast("long")) - F.col("x")).where("length > 0")
    best = m.groupBy("img", "pos").agg(F.min(F.struct((-F.col("length")).alias("n"), "code")).alias("b"))
    return best.select("img", "pos", (-F.col("b.n")).alias("length"), "b.code")


def stream_bytes(header_bits: Column, data_bits: Column, extra_bits: Column) -> Column:
    """Whole bytes of a stream."""
    return P.div(header_bits + data_bits + extra_bits + 7, 8)


def alpha_choice(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """(img, filter, packed, bytes): the smallest of the raw plane, a byte a pixel, and of the coded ones; raw wins ties, then the filters in order.

    candidates: (img, ord, filter, bytes). raw: (img, pixels).
    """
    own = raw.select("img", F.lit(-1).alias("ord"), F.lit("none").alias("filter"), F.lit(False).alias("packed"), F.col("pixels").alias("bytes"))
    both = candidates.select("img", F.col("ord").cast("int").alias("ord"), "filter", F.lit(True).alias("packed"), "bytes").unionByName(own)
    return both.groupBy("img").agg(F.min(F.struct("bytes", "ord", "filter", "packed")).alias("b")).select("img", "b.filter", "b.packed", "b.bytes")


def useful_caches(hits: DataFrame, least: int = 8) -> DataFrame:
    """Cache sizes with enough hits."""
    return hits.where(F.col("hits") >= least)


def cache_costs(px: DataFrame, bits: list[int]) -> DataFrame:
    """(img, bits, hits, literals, cost): each cache size's screening cost, an index of `bits` bits for a hit and 32 bits for a literal.

    All sizes come from one scan: a pixel is laid out once a size and compared with the last one in its slot.
    """
    p = px.select("img", "pos", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("bits"), P.cache_slot(F.col("p"), n).alias("slot")) for n in bits]))
    s = p.select("img", "pos", "p", each.alias("e")).select("img", "pos", "p", "e.bits", "e.slot")
    hit = (F.lag("p").over(Window.partitionBy("img", "bits", "slot").orderBy("pos")) == F.col("p")).cast("long")
    c = s.withColumn("hit", F.coalesce(hit, F.lit(0))).groupBy("img", "bits").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    return c.select("img", "bits", "hits", (F.col("n") - F.col("hits")).alias("literals"), (F.col("hits") * F.col("bits") + (F.col("n") - F.col("hits")) * 32).alias("cost"))


def sampled_counts(px: DataFrame, size_bits: int, limit: int, value: Column) -> DataFrame:
    """(img, tx, ty, value, n): values at every step-th pixel of each block, so that at most about `limit` pixels of a block count."""
    edge = 1 << size_bits
    step = max(1, edge * edge // limit)
    inside = (F.col("y") % edge) * edge + F.col("x") % edge
    p = px.where(inside % step == 0).select("img", F.shiftright("x", size_bits).alias("tx"), F.shiftright("y", size_bits).alias("ty"), value.alias("value"))
    return p.groupBy("img", "tx", "ty", "value").agg(F.count("*").alias("n"))


def forward_filled(tiles: DataFrame, *by: str) -> DataFrame:
    """Tiles (by..., tile, grp) without a group take that of the tile before; 0 if there is none."""
    before = Window.partitionBy(*by).orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)
    return tiles.withColumn("grp", F.coalesce(F.last("grp", ignorenulls=True).over(before), F.lit(0)))


def renumbered(tiles: DataFrame, *by: str) -> DataFrame:
    """Groups numbered from 0 in the order in which tiles first have them."""
    first = tiles.withColumn("first", F.min("tile").over(Window.partitionBy(*by, "grp")))
    return first.withColumn("grp", (F.dense_rank().over(Window.partitionBy(*by).orderBy("first")) - 1).cast("int")).drop("first")


def regrouped(histograms: DataFrame, costs: DataFrame, fallback: int, *by: str) -> DataFrame:
    """(by..., tile, grp, cost): the group that codes each tile's symbols in the fewest bits; a symbol it lacks costs `fallback`.

    histograms: (by..., tile, symbol, n). costs: (by..., grp, symbol, bits); a group has a few hundred symbols at most.
    """
    groups = costs.select(*by, "grp").distinct()
    pairs = histograms.join(groups, list(by)).join(costs, [*by, "grp", "symbol"], "left")
    total = pairs.groupBy(*by, "tile", "grp").agg(F.sum(F.col("n") * F.coalesce("bits", F.lit(fallback))).alias("cost"))
    return total.groupBy(*by, "tile").agg(F.min(F.struct("cost", "grp")).alias("b")).select(*by, "tile", "b.grp", "b.cost")


def palette(px: DataFrame, most: int = 256) -> DataFrame:
    """(img, p, ord, sorted): colours of the images with at most `most`, numbered as they first appear and by value."""
    p = px.select("img", "pos", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    first = p.groupBy("img", "p").agg(F.min("pos").alias("first"))
    n = first.withColumn("n", F.count("*").over(Window.partitionBy("img"))).where(F.col("n") <= most)
    place = lambda c: F.row_number().over(Window.partitionBy("img").orderBy(c)) - 1
    return n.select("img", "p", place("first").alias("ord"), place("p").alias("sorted"))


def extra_bits(tokens: DataFrame, *by: str) -> DataFrame:
    """(by..., copies, extra): extra bits of the length and distance codes of copies (length, code)."""
    n = P.prefix_code(F.col("length"))[1] + P.prefix_code(F.col("code"))[1]
    return tokens.groupBy(*by).agg(F.count("*").alias("copies"), F.sum(n.cast("long")).alias("extra"))


def coded_bits(counts: DataFrame, lengths: DataFrame, fallback: int, *by: str) -> DataFrame:
    """(by..., bits): symbols (by..., symbol, n) in a code of lengths (by..., symbol, length); a code of one symbol takes no bits."""
    kinds = lengths.withColumn("kinds", F.count("*").over(Window.partitionBy(*by)))
    cost = F.when(F.col("kinds") == 1, 0).otherwise(F.coalesce("length", F.lit(fallback)))
    return counts.join(kinds, [*by, "symbol"], "left").groupBy(*by).agg(F.sum(F.col("n") * cost).alias("bits"))


def token_cost(tokens: DataFrame, probabilities: DataFrame, *node: str) -> DataFrame:
    """(block, cost): cost in 1/256 bit of the coefficient tokens (block, skipped, node..., bit, n) of blocks that are not skipped."""
    from pixelloom.operators.quantizers import bit_cost

    j = tokens.where(~F.col("skipped")).join(probabilities, list(node))
    return j.groupBy("block").agg(F.sum(F.col("n") * F.when(F.col("bit"), bit_cost(F.col("probability"), True)).otherwise(bit_cost(F.col("probability"), False))).alias("cost"))


def layout_sum(layouts: DataFrame) -> DataFrame:
    """One row: every number summed, truths joined by OR."""
    add = [F.bool_or(c).alias(c) if t == "boolean" else F.sum(c).alias(c) for c, t in layouts.dtypes if t in ("boolean", "int", "bigint")]
    return layouts.agg(F.count("*").alias("files"), *add)


def sharp_chroma(px: DataFrame, filtered: DataFrame) -> DataFrame:
    """(img, cx, cy, cb, cr, error): of the values up to 2 around the filtered sample and around the plain mean of its four pixels,
    the one whose colours are nearest to the source; of equals the first, the filtered sample before all others.

    filtered: (img, cx, cy, cb, cr). At most 50 candidates a sample are laid out, each with its four pixels' error summed in place.
    """
    cb, cr = P.chroma(F.col("r"), F.col("g"), F.col("b"))
    cell = px.select("img", F.shiftright("x", 1).alias("cx"), F.shiftright("y", 1).alias("cy"), F.struct("r", "g", "b", P.luma(F.col("r"), F.col("g"), F.col("b")).alias("l")).alias("p"), cb.alias("u"), cr.alias("v"))
    cells = cell.groupBy("img", "cx", "cy").agg(F.collect_list("p").alias("px"), P.div(F.sum("u") + 2, 4).cast("int").alias("mean_cb"), P.div(F.sum("v") + 2, 4).cast("int").alias("mean_cr"))
    j = cells.join(filtered.select("img", "cx", "cy", F.col("cb").cast("int").alias("cb"), F.col("cr").cast("int").alias("cr")), ["img", "cx", "cy"])
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    around = lambda n, u, v: [F.struct(F.lit(n).alias("n"), (F.col(u) + a).alias("cb"), (F.col(v) + b).alias("cr")) for a, b in steps]
    tries = F.array(F.struct(F.lit(0).alias("n"), F.col("cb").alias("cb"), F.col("cr").alias("cr")), *around(1, "cb", "cr"), *around(2, "mean_cb", "mean_cr"))

    def error(t: Column) -> Column:
        def one(p: Column) -> Column:
            rgb = P.yuv_to_rgb(p["l"], t["cb"], t["cr"])
            return sum(((x - p[c]) * (x - p[c]) for x, c in zip(rgb, "rgb")), F.lit(0)).cast("long")

        return F.aggregate("px", F.lit(0).cast("long"), lambda so_far, p: so_far + one(p))

    good = F.filter(tries, lambda t: t["cb"].between(0, 255) & t["cr"].between(0, 255))
    best = F.array_min(F.transform(good, lambda t: F.struct(error(t).alias("error"), t["n"].alias("n"), t["cb"].alias("cb"), t["cr"].alias("cr"))))
    return j.select("img", "cx", "cy", best.alias("b")).select("img", "cx", "cy", "b.cb", "b.cr", "b.error")


def ablation(runs: DataFrame, baseline: str) -> DataFrame:
    """(variant, fixtures, bytes, baseline_bytes, percent): each variant's total over the fixtures that the baseline has too."""
    base = runs.where(F.col("variant") == baseline).select("fixture", F.col("bytes").alias("baseline_bytes"))
    t = runs.join(base, "fixture").groupBy("variant").agg(F.count("*").alias("fixtures"), F.sum("bytes").alias("bytes"), F.sum("baseline_bytes").alias("baseline_bytes"))
    return t.withColumn("percent", F.round(P.percent_delta(F.col("bytes"), F.col("baseline_bytes")), 6))


def error_diffused(values: DataFrame, step: int, *by: str) -> DataFrame:
    """(by..., ord, value, level): values over a step in order, each with half the error of the one before; order matters, so a group is one unit of work."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t, levels, carry = t.sort_values("ord"), [], 0
        for v in t["value"].tolist():
            want = v + carry
            level = (abs(want) + step // 2) // step * (1 if want >= 0 else -1)
            carry = int((want - level * step) / 2)
            levels.append(level)
        return t.assign(level=levels)

    kinds = dict(values.dtypes)
    return values.select(*by, "ord", "value").groupBy(*by).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), f"ord {kinds['ord']}", f"value {kinds['value']}", "level long"]))
