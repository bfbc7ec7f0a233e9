"""Quantizers, their biases and filters, rate-distortion profiles, and probabilities of branches, as columns and small tables.

Everything here is one row in, one row out, or one aggregate; values that a decoder must share are marked as fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P

# Fixed values of the bitstream format: steps by quantizer index, for DC and for all other coefficients.
DC_STEPS = [
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
]
AC_STEPS = [
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
]
# Weights of a 4 x 4 Hadamard transform, by rows.
TEXTURE_WEIGHTS = [38, 32, 20, 9, 32, 28, 17, 7, 20, 17, 10, 4, 9, 7, 4, 2]
# The largest magnitude, and the first one, of each coefficient category beyond the small ones.
CATEGORIES = [(18, 11), (34, 19), (66, 35), (None, 67)]
# Fixed values of the bitstream format: probabilities of 256 in the trees of prediction modes, as (probability, bit) on the way to each mode.
LUMA_PATHS = {"small": [(145, 0)], "dc": [(145, 1), (156, 0), (163, 0)], "vertical": [(145, 1), (156, 0), (163, 1)], "horizontal": [(145, 1), (156, 1), (128, 0)], "true-motion": [(145, 1), (156, 1), (128, 1)]}
CHROMA_PATHS = {"dc": [(142, 0)], "vertical": [(142, 1), (114, 0)], "horizontal": [(142, 1), (114, 1), (183, 0)], "true-motion": [(142, 1), (114, 1), (183, 1)]}
#: Planes with a step of their own.
STEPS = ["y1_dc", "y1_ac", "y2_dc", "y2_ac", "uv_dc", "uv_ac"]


def _step(table: list[int], index: Column, most: int = 127) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in table]), P.clip(index, 0, most).cast("int") + 1)


def steps(q: Column, y1_dc: int = 0, y2_dc: int = 0, y2_ac: int = 0, uv_dc: int = 0, uv_ac: int = 0) -> dict[str, Column]:
    """Quantizer steps of all planes at an index, with each plane's offset to it."""
    q = P.clip(q, 0, 127)
    return {
        "y1_dc": _step(DC_STEPS, q + y1_dc), "y1_ac": _step(AC_STEPS, q),
        # second-order coefficients: twice the DC step, and 155 hundredths of the AC step, 8 at least
        "y2_dc": F.greatest(_step(DC_STEPS, q + y2_dc) * 2, F.lit(8)), "y2_ac": F.greatest(P.div(_step(AC_STEPS, q + y2_ac) * 155, 100).cast("int"), F.lit(8)),
        "uv_dc": _step(DC_STEPS, q + uv_dc, 117), "uv_ac": _step(AC_STEPS, q + uv_ac),
    }


def biases(q: Column, profile: str) -> dict[str, Column]:
    """Rounding biases in 1/256 of a step: 'neutral', 'conservative', or 'mild' (chroma follows the index)."""
    luma = F.lit({"neutral": 128, "conservative": 124, "mild": 116}[profile])
    if profile != "mild":
        return dict.fromkeys(STEPS, luma)
    fine, coarse = P.clip(F.lit(130) - P.div(q, 4), 124, 128), P.clip(F.lit(150) - q, 96, 124)
    chroma = F.when(q < 26, fine).otherwise(coarse).cast("int")
    return {s: chroma if s.startswith("uv") else luma for s in STEPS}


def loop_filter(q: Column) -> dict[str, Column]:
    """Level and sharpness of the loop filter; the first mode delta applies where there is a level."""
    level = F.least(P.div(q, 6) + 4, F.lit(24))
    level = F.when(q <= 8, F.greatest(level - 2, F.lit(0))).otherwise(level).cast("int")
    return {"level": level, "sharpness": F.least(P.div(q, 32), F.lit(3)).cast("int"), "deltas": level > 0}


def quality_profile(q: Column) -> dict[str, Column]:
    """What a quantizer index sets: lambda scales (256 is one), texture weight, luma bias, and the chroma DC offset."""
    middle = (q >= 15) & (q <= 30)
    return {
        "luma_lambda": F.when(q <= 9, 32).otherwise(64), "chroma_lambda": F.lit(96), "texture": F.when(middle, 200).otherwise(0),
        "luma_bias": F.when(middle, 114).otherwise(116), "chroma_dc_offset": F.lit(-2),
    }


#: Effort by mode; the fields that differ from the first row are stated. `fine` fields hold only for indexes of up to 9.
_EFFORT = {"try_small": True, "try_skip": True, "update_probabilities": True, "buffer_residuals": True, "keep_source": "fine", "segments": 4, "passes": 1, "sharp": "fine", "parallel_alpha": True, "flatness": 1, "beam": 0}
EFFORTS = {
    "default": _EFFORT,
    "best": _EFFORT | {"keep_source": True, "passes": 2, "sharp": True, "flatness": 0, "beam": 2},
    "fast": _EFFORT | {"try_small": False, "try_skip": False, "update_probabilities": False, "buffer_residuals": False, "keep_source": False, "segments": 1, "parallel_alpha": False},
    "low-memory": _EFFORT | {"try_small": False, "buffer_residuals": False, "keep_source": False, "segments": 1, "parallel_alpha": False},
}


def effort_profiles(df: DataFrame, q: str = "q") -> DataFrame:
    """df with a row for each mode and its search effort at the row's quantizer index."""
    fine = F.col(q) <= 9
    value = lambda v: fine if v == "fine" else F.lit(v)
    rows = [F.struct(F.lit(mode).alias("mode"), *[value(v).alias(k) for k, v in e.items()]) for mode, e in EFFORTS.items()]
    return df.withColumn("effort", F.explode(F.array(*rows))).select(*df.columns, "effort.*")


def candidate_modes(mbx: Column, mby: Column) -> Column:
    """Prediction modes that a macroblock may try: DC always; vertical, horizontal and true motion where what they read exists."""
    all_ = F.array(F.struct(F.lit("dc").alias("m"), F.lit(True).alias("ok")), F.struct(F.lit("vertical").alias("m"), (mby > 0).alias("ok")), F.struct(F.lit("horizontal").alias("m"), (mbx > 0).alias("ok")), F.struct(F.lit("true-motion").alias("m"), ((mbx > 0) & (mby > 0)).alias("ok")))
    return F.transform(F.filter(all_, lambda s: s["ok"]), lambda s: s["m"])


def coefficient_category(v: Column) -> tuple[Column, Column]:
    """(category, its first magnitude) of a coefficient's magnitude of 11 or more."""
    category, first = F.lit(3), F.lit(CATEGORIES[3][1])
    for i in (2, 1, 0):
        most, start = CATEGORIES[i]
        category, first = F.when(v <= most, i).otherwise(category), F.when(v <= most, start).otherwise(first)
    return category, first


def texture(block: Column) -> Column:
    """Weighted sum of the magnitudes of a 4 x 4 block's Hadamard transform. block: array of 16 values by rows."""
    at = lambda i: F.element_at(block, i + 1)

    def butterfly(v: list[Column]) -> list[Column]:
        even, odd, diff_odd, diff_even = v[0] + v[2], v[1] + v[3], v[1] - v[3], v[0] - v[2]
        return [even + odd, diff_even + diff_odd, diff_even - diff_odd, even - odd]

    rows = [butterfly([at(4 * y + x) for x in range(4)]) for y in range(4)]
    columns = [butterfly([rows[y][x] for y in range(4)]) for x in range(4)]
    total = F.lit(0)
    for x in range(4):
        for y in range(4):
            total = total + F.abs(columns[x][y]) * TEXTURE_WEIGHTS[4 * y + x]
    return total.cast("long")


def texture_distortion(a: Column, b: Column) -> Column:
    return F.shiftright(F.abs(texture(a) - texture(b)), 5)


def branch_probability(zeros: Column, total: Column) -> Column:
    """Probability (of 255) of the first branch; 255 where the second one never occurs."""
    return F.when((total <= 0) | (zeros >= total), 255).when(zeros <= 0, 0).otherwise(P.clip(P.div(zeros * 255 + P.div(total, 2), F.greatest(total, F.lit(1))), 0, 255)).cast("int")


def segment_probabilities(blocks: DataFrame, *by: str, segment: str = "segment") -> DataFrame:
    """(by..., p0, p1, p2): probabilities of the tree of four segments."""
    n = [F.count_if(F.col(segment) == s) for s in range(4)]
    c = blocks.groupBy(*by).agg(*[x.alias(f"n{i}") for i, x in enumerate(n)])
    left, right = F.col("n0") + F.col("n1"), F.col("n2") + F.col("n3")
    return c.select(*by, branch_probability(left, left + right).alias("p0"), branch_probability(F.col("n0"), left).alias("p1"), branch_probability(F.col("n2"), right).alias("p2"))


def skip_probability(blocks: DataFrame, *by: str, skipped: str = "skipped") -> DataFrame:
    """(by..., blocks, skip): probability of 255, from 1 on, that a macroblock is not skipped."""
    c = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.count_if(~F.col(skipped)).alias("kept"))
    return c.select(*by, "blocks", P.clip(P.div(F.col("kept") * 255 + P.div(F.col("blocks"), 2), F.col("blocks")), 1, 255).cast("int").alias("skip"))


def bit_cost(probability: Column, bit: bool) -> Column:
    """Cost in 1/256 bit of a bit whose 0 has this probability of 256."""
    return P.probability_cost(F.lit(256) - probability if bit else probability)


def chosen_probabilities(stats: DataFrame) -> DataFrame:
    """stats (..., zero, one, current, update): each node's probability, sent anew where that costs less than it saves.

    update is the probability of 256 that a node is not sent. Nodes that never occur keep their probability.
    """
    total = F.col("zero") + F.col("one")
    estimate = F.when(total == 0, 128).otherwise(P.clip(P.div(F.col("zero") * 256 + P.div(total, 2), F.greatest(total, F.lit(1))), 1, 255)).cast("int")
    s = stats.withColumn("estimate", estimate)
    counts = lambda p: F.col("zero") * bit_cost(p, False) + F.col("one") * bit_cost(p, True)
    s = s.withColumn("keep_cost", bit_cost(F.col("update"), False) + counts(F.col("current")))
    s = s.withColumn("update_cost", bit_cost(F.col("update"), True) + 8 * 256 + counts(F.col("estimate")))
    sent = (total > 0) & (F.col("estimate") != F.col("current")) & (F.col("update_cost") < F.col("keep_cost"))
    return s.withColumn("sent", sent).withColumn("probability", F.when(sent, F.col("estimate")).otherwise(F.col("current")))


def indexes(spark: SparkSession) -> DataFrame:
    return spark.range(128).select(F.col("id").cast("int").alias("q"))


def mode_costs(spark: SparkSession) -> DataFrame:
    """(plane, mode, cost): cost in 1/256 bit of naming a macroblock's prediction mode; 'small' is that of 4 x 4 luma modes, before these."""
    rows = [(plane, mode, i, p, bool(b)) for plane, paths in (("luma", LUMA_PATHS), ("chroma", CHROMA_PATHS)) for mode, path in paths.items() for i, (p, b) in enumerate(path)]
    steps_ = spark.createDataFrame(rows, "plane string, mode string, step int, p int, bit boolean")
    return steps_.groupBy("plane", "mode").agg(F.sum(F.when(F.col("bit"), bit_cost(F.col("p"), True)).otherwise(bit_cost(F.col("p"), False))).alias("cost"))


def segment_steps(blocks: DataFrame, segments: DataFrame, fallback: int) -> DataFrame:
    """Macroblocks (img, segment, ...) with their segment's quantizer index and steps; segments: (img, segment, q). A segment that is not listed has the fallback."""
    j = blocks.join(segments, ["img", "segment"], "left").withColumn("q", F.coalesce("q", F.lit(fallback)))
    return j.select(*j.columns, *[c.cast("int").alias(k) for k, c in steps(F.col("q")).items()])
