"""What an encoder looks at before it chooses: samples, tiles, block predictors, repeats, and alpha filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.functions import vp8l
from pixelloom.operators import histograms, stencils

SAMPLES = 2048
SAMPLE_COLOURS = 257
ALPHA_FILTERS = ("none", "horizontal", "vertical", "gradient")


def _order():
    return Window.partitionBy("img").orderBy("pos")


def sample_statistics(px: DataFrame, width: int) -> DataFrame:
    """(img, samples, colours, translucent, delta, pairs) of at most SAMPLES evenly strided pixels of images of one width."""
    far = lambda n: sum((F.abs(F.col(c) - F.lead(c, n).over(_order())) for c in "rgba"), F.lit(0))
    j = px.withColumns({"right": F.when(F.col("x") + 1 < width, far(1)), "down": far(width)})
    total = F.col("width").cast("long") * F.col("height")
    step = F.when(total > SAMPLES, P.div(total, SAMPLES)).otherwise(F.lit(1).cast("long"))
    s = j.where((F.col("pos") % step == 0) & (P.div(F.col("pos"), step) < SAMPLES))
    p = P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    return s.groupBy("img").agg(
        F.count("*").alias("samples"), F.least(F.count_distinct(p), F.lit(SAMPLE_COLOURS).cast("long")).alias("colours"), F.count_if(F.col("a") != 255).alias("translucent"),
        (F.coalesce(F.sum("right"), F.lit(0)) + F.coalesce(F.sum("down"), F.lit(0))).alias("delta"), (F.count("right") + F.count("down")).alias("pairs"),
    )


def profile(stats: DataFrame) -> DataFrame:
    """Adds the kind of image that the samples suggest."""
    kind = (
        F.when(F.col("samples") == 0, "balanced").when(F.col("translucent") * 2 >= F.col("samples"), "alpha").when(F.col("colours") <= 1, "flat")
        .when((F.col("pairs") > 0) & (F.col("delta") <= F.col("pairs") * 48), "gradient").when(F.col("colours") >= 128, "photo").otherwise("balanced")
    )
    return stats.withColumn("kind", kind)


def tile_entropy(px: DataFrame, bits: int) -> DataFrame:
    """(img, tx, ty, channel, symbols, entropy) of every square tile of 2^bits pixels."""
    t = px.withColumns({"tx": F.shiftright("x", bits), "ty": F.shiftright("y", bits)})
    return histograms.channel_counts(t, "img", "tx", "ty").groupBy("img", "tx", "ty", "channel").agg(F.count("*").alias("symbols"), F.round(histograms.entropy(F.col("n")), 4).alias("entropy"))


def block_predictors(px: DataFrame, width: int, bits: int, modes: list[int] | None = None) -> DataFrame:
    """(img, tx, ty, mode, cost): each block's mode of least residual entropy over its channels; the lowest of equals."""
    r = stencils.residuals(px, width, modes).withColumns({"tx": F.shiftright("x", bits), "ty": F.shiftright("y", bits)})
    by = ("img", "tx", "ty", "mode")
    e = histograms.channel_counts(r, *by).groupBy(*by, "channel").agg(histograms.entropy(F.col("n")).alias("e"))
    cost = e.groupBy(*by).agg(F.round(F.sum("e"), 4).alias("cost"))
    best = cost.groupBy("img", "tx", "ty").agg(F.min(F.struct("cost", "mode")).alias("b"))
    return best.select("img", "tx", "ty", "b.mode", "b.cost")


def three_pixel_hash(a: Column, b: Column, c: Column, bits: int = 16) -> Column:
    h = P.low32_product(a, 0x1E35A7BD).bitwiseXOR(P.low32_product(b, 0x85EBCA6B)).bitwiseXOR(P.low32_product(c, 0xC2B2AE35))
    h = h.bitwiseXOR(F.shiftright(h, 16))
    return F.shiftright(h, 32 - bits)


def hash_repeats(px: DataFrame) -> DataFrame:
    """(img, hashed, repeats, near): positions with a 3-pixel hash, those whose last place of that hash holds the same 3 pixels, and those of them within 1024 pixels.

    The last place of a hash comes from a window over (image, hash), not from a self-join.
    """
    w = _order()
    p = px.select("img", "pos", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    p = p.select("img", "pos", "p", F.lead("p", 1).over(w).alias("p1"), F.lead("p", 2).over(w).alias("p2")).where("p2 IS NOT NULL")
    p = p.withColumn("h", three_pixel_hash(F.col("p"), F.col("p1"), F.col("p2")))
    k = Window.partitionBy("img", "h").orderBy("pos")
    last = lambda c: F.lag(c).over(k)
    same = (last("p") == F.col("p")) & (last("p1") == F.col("p1")) & (last("p2") == F.col("p2"))
    m = p.select("img", same.alias("same"), (F.col("pos") - last("pos")).alias("d"))
    return m.groupBy("img").agg(F.count("*").alias("hashed"), F.count_if("same").alias("repeats"), F.count_if(F.col("same") & (F.col("d") <= 1024)).alias("near"))


def alpha_residuals(px: DataFrame, width: int) -> DataFrame:
    """(img, filter, pos, v): wrapped alpha residuals of the four filters."""
    w = _order()
    left, above, corner = (F.lag("a", n).over(w) for n in (1, width, width + 1))
    p = px.select("img", "pos", "x", "y", "a", left.alias("l"), above.alias("t"), corner.alias("tl"))
    x0, y0 = F.col("x") == 0, F.col("y") == 0
    guess = {
        "none": F.lit(0), "horizontal": F.when(~x0, F.col("l")).when(~y0, F.col("t")).otherwise(0), "vertical": F.when(~y0, F.col("t")).when(~x0, F.col("l")).otherwise(0),
        "gradient": F.when(x0 & y0, 0).when(x0, F.col("t")).when(y0, F.col("l")).otherwise(P.clip(F.col("l") + F.col("t") - F.col("tl"))),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("filter"), P.wrap(F.col("a") - g).alias("v")) for k, g in guess.items()]))
    return p.select("img", "pos", each.alias("e")).select("img", "e.filter", "pos", "e.v")


def alpha_filter_costs(px: DataFrame, width: int) -> DataFrame:
    """(img, filter, symbols, entropy) of each filter's residuals."""
    n = alpha_residuals(px, width).groupBy("img", "filter", "v").agg(F.count("*").alias("n"))
    return n.groupBy("img", "filter").agg(F.count("*").alias("symbols"), F.round(histograms.entropy(F.col("n")), 4).alias("entropy"))


def distance_codes(distances: DataFrame, width: int) -> DataFrame:
    """(distance, code): near neighbours by their place in the format's list, others beyond it."""
    spark = distances.sparkSession
    near = spark.createDataFrame([(x + y * width, i + 1) for i, (x, y) in enumerate(vp8l.NEAR) if x + y * width > 0], "distance long, near int").groupBy("distance").agg(F.min("near").alias("near"))
    j = distances.join(F.broadcast(near), "distance", "left")  # 120 rows at most
    return j.select("distance", F.coalesce(F.col("near").cast("long"), F.col("distance") + len(vp8l.NEAR)).alias("code"))


def ranked(candidates: DataFrame, finalists: int) -> DataFrame:
    """The first candidates of (img, family, rank, ord) by rank, taking each family's best before any second."""
    own = Window.partitionBy("img", "family").orderBy("rank", "ord")
    turn = candidates.withColumn("turn", F.row_number().over(own))
    return turn.withColumn("place", F.row_number().over(Window.partitionBy("img").orderBy("turn", "rank", "ord"))).where(F.col("place") <= finalists).drop("turn")


def chosen(fixtures: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The fixtures with these ids (first of repeated ids), and the ids that none has."""
    spark = fixtures.sparkSession
    want = spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "img string, ord int")
    return fixtures.join(F.broadcast(want), "img"), want.join(fixtures.select("img").distinct(), "img", "left_anti")
