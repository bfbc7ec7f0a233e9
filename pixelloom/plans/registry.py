"""All queries of the library and, where DuckDB can express them, the SQL that gives the same rows.

Queries named image_* run on the standard images, which are generated; their size does not follow the scale factor. The others
run the same operators on the tables of the given folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.operators import blocks, corpus, distortion, histograms, images, lossy, planning, rate_distortion, stencils
from pixelloom.plans import coding
from pixelloom.sources.fixtures import hidden_rgb, image, pixels

SMALL = ["gradient128", "flat128", "alpha128"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-distortion samples made of line items: one a fixture, encoder and quality."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = t.select(
        (F.col("l_partkey") % 50).alias("fixture"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("encoder"), F.col("l_quantity").cast("int").alias("quality"),
        F.floor("l_extendedprice").cast("long").alias("bytes"), "l_orderkey", "l_linenumber",
    )
    s = s.groupBy("fixture", "encoder", "quality").agg(F.min(F.struct("bytes", "l_orderkey", "l_linenumber")).alias("m"), F.count("*").alias("n"))
    return s.select(
        "fixture", "encoder", "quality", F.col("m.bytes").alias("bytes"), F.when(F.col("m.bytes") % 17 == 0, None).otherwise((F.col("quality") + F.col("m.bytes") % 7).cast("double")).alias("ssim_db"),
        (F.lit(200.0) - F.col("quality") * 3 + F.col("m.bytes") % 11).alias("mse"), ((F.col("fixture") + 1) * 1000).alias("pixels"),
    )


SAMPLES_SQL = """samples AS (
  SELECT fixture, encoder, quality, bytes, CASE WHEN bytes % 17 = 0 THEN NULL ELSE CAST(quality + bytes % 7 AS DOUBLE) END AS ssim_db,
         CAST(200.0 - quality * 3 + bytes % 11 AS DOUBLE) AS mse, (fixture + 1) * 1000 AS pixels
  FROM (SELECT l_partkey % 50 AS fixture, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS encoder, CAST(floor(l_quantity) AS INTEGER) AS quality,
               min(CAST(floor(l_extendedprice) AS BIGINT)) AS bytes FROM lineitem GROUP BY ALL))"""
QD = "CASE WHEN l.ssim_db IS NULL AND r.ssim_db IS NULL THEN 0.0 WHEN l.ssim_db IS NULL OR r.ssim_db IS NULL THEN 1e6 - coalesce(l.ssim_db, r.ssim_db) ELSE abs(l.ssim_db - r.ssim_db) END"


def _nearest_sql(keys: str) -> str:
    return f"""WITH {SAMPLES_SQL}, m AS (
  SELECT l.fixture, l.quality AS l_quality, l.bytes AS l_bytes, l.ssim_db AS l_ssim_db, r.quality AS r_quality, r.bytes AS r_bytes, r.ssim_db AS r_ssim_db,
         row_number() OVER (PARTITION BY l.fixture, l.quality ORDER BY {keys}, r.quality) AS n
  FROM samples l JOIN samples r ON l.fixture = r.fixture WHERE l.encoder = 'a' AND r.encoder = 'b')
SELECT fixture, l_quality, l_bytes, r_quality, r_bytes, l_bytes - r_bytes AS d_bytes, round(CASE WHEN r_bytes = 0 THEN 0.0 ELSE (l_bytes - r_bytes) * 100.0 / r_bytes END, 6) AS d_percent,
       round(CASE WHEN l_ssim_db IS NULL AND r_ssim_db IS NULL THEN 0.0 ELSE l_ssim_db - r_ssim_db END, 6) AS d_ssim_db FROM m WHERE n = 1"""


def _match(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    m = rate_distortion.with_deltas(rate_distortion.nearest(_samples(spark, sf_dir), "a", "b", by))
    return m.select("fixture", "l_quality", "l_bytes", "r_quality", "r_bytes", "d_bytes", "d_percent", "d_ssim_db")


def corpus_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summary(corpus.indexed(_documents(spark, sf_dir), F.col("text")), "n_chars")


def corpus_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distribution(_documents(spark, sf_dir), "n_chars", "lang")


def corpus_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.group_totals(_documents(spark, sf_dir), "lang", "source", "n_chars")


def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.indexed(_documents(spark, sf_dir), F.col("text"), 25).select("doc_id", "id", "split")


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_digest(corpus.indexed(_documents(spark, sf_dir), F.col("text")))


def match_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "size")


def match_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "quality")


def quality_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_distortion.by_quality(_samples(spark, sf_dir), "a", "b")


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).where("ssim_db IS NOT NULL").select("fixture", "encoder", F.col("bytes").alias("rate"), F.col("ssim_db").alias("quality"))
    return rate_distortion.pareto(s, "fixture", "encoder")


def bd_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).where("ssim_db IS NOT NULL AND bytes > 0").select("fixture", "encoder", F.log(F.col("bytes") / F.col("pixels")).alias("log_rate"), F.col("ssim_db").alias("quality"))
    return rate_distortion.bjontegaard(s, "a", "b")


def timing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.floor("l_extendedprice").cast("long").alias("ns"))
    return rate_distortion.timing(t, "l_suppkey")


def image_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.facts(pixels(spark))


def image_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.channel_entropy(histograms.subtract_green(pixels(spark)), "img")


def image_hidden_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.channel_counts(hidden_rgb(spark), "img")


def image_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    y, (cb, cr) = P.luma(r, g, b), P.chroma(r, g, b)
    px = pixels(spark).select("img", y.alias("y8"), cb.alias("cb"), cr.alias("cr"))
    back = P.yuv_to_rgb(F.col("y8"), F.col("cb"), F.col("cr"))
    return px.select("img", "y8", "cb", "cr", *[v.alias(k) for k, v in zip(("r2", "g2", "b2"), back)]).groupBy("img").agg(*[F.sum(c).alias(c) for c in ("y8", "cb", "cr", "r2", "g2", "b2")])


def image_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = stencils.residuals(pixels(spark, SMALL), 128)
    return res.groupBy("img", "mode").agg(*[F.sum(c).alias(c) for c in "rgba"])


def image_colour_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, SMALL)
    e = histograms.estimate_colour(px, "img")
    out = histograms.apply_colour(px, e, "img").groupBy("img").agg(F.sum("r").alias("r"), F.sum("b").alias("b"))
    return out.join(e, "img")


def image_near_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = stencils.near_lossless(pixels(spark, SMALL), 128, 128, 40)
    return px.groupBy("img").agg(*[F.sum(c).alias(c) for c in "rgb"])


def image_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, SMALL)
    return distortion.measure(px, stencils.near_lossless(px, 128, 128, 40))


def image_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, SMALL)
    return distortion.luma_ssim(px, stencils.near_lossless(px, 128, 128, 20))


def image_chroma_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stencils.chroma_planes(pixels(spark, SMALL), 128, 128)
    return c.groupBy("img").agg(F.count("*").alias("n"), F.sum("cb").alias("cb"), F.sum("cr").alias("cr"))


def image_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.packed_indexes(pixels(spark, ["ui256", "flat128", "palette256", "gradient128"])).groupBy("img").agg(F.count("*").alias("n"), F.sum("packed").alias("packed"))


def image_palette_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.palette_deltas(pixels(spark, ["ui256", "palette256"]))


def image_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.cache_hits(pixels(spark, ["ui256", "palette256", "alpha128"]), [1, 4, 8, 11])


def image_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.runs(pixels(spark, ["ui256", "flat128"]))


def image_offset_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.offset_matches(pixels(spark, ["ui256", "palette256"]), 256)


def image_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.activity(pixels(spark))


def image_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.segments(blocks.activity(pixels(spark))).groupBy("img", "segment").agg(F.count("*").alias("n"), F.min("activity").alias("low"), F.max("activity").alias("high"))


def image_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = histograms.huffman(histograms.channel_counts(pixels(spark), "img"), "img", "channel")
    return histograms.canonical_codes(lengths, "img", "channel")


def image_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pixel_identity(pixels(spark, SMALL))


def image_block_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transform, quantize, restore: squared error by quantizer."""
    b = blocks.luma_blocks(image(spark, "alpha128")).withColumn("q", F.explode(F.array(*[F.lit(q) for q in (4, 16, 64)])))
    b = b.withColumn("c", blocks.forward_dct(F.transform("v", lambda v: v - 128)))
    b = b.withColumn("d", F.transform("c", lambda v: P.quantize(v, F.col("q")) * F.col("q"))).withColumn("p", F.array_repeat(F.lit(128), 16))
    b = b.withColumn("e", F.zip_with("v", blocks.inverse_dct(F.col("p"), F.col("d")), lambda a, z: (a - z) * (a - z)))
    return b.groupBy("q").agg(F.count("*").alias("blocks"), F.sum(F.aggregate("e", F.lit(0), lambda t, v: t + v)).alias("squared"))


def image_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: the pixels that come back."""
    back = images.decode(images.encode(images.packed(pixels(spark, SMALL)).repartition(3, "img"), "default"))
    return back.groupBy("img").agg(F.count("*").alias("pixels"), F.sum(P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a"))).alias("total"))


def image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.layout(images.encode(images.packed(pixels(spark, ["flat128", "gradient128"])).repartition(2, "img"), "fast"))


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.best_candidate(images.candidates(images.packed(hidden_rgb(spark)), "best"))


def image_lossy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lossy.curve(lossy.modes(lossy.planes(pixels(spark, SMALL), 128, 128), 128, 128, [4, 16, 64]))


def image_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.profile(planning.sample_statistics(pixels(spark, SMALL), 128))


def image_tile_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.tile_entropy(pixels(spark, ["ui256", "alpha128"]), 5)


def image_block_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.block_predictors(pixels(spark, SMALL), 128, 5)


def image_hash_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.hash_repeats(pixels(spark, ["ui256", "palette256", "alpha128"]))


def image_alpha_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.alpha_filter_costs(pixels(spark, ["alpha128"]), 128)


def codes_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.distance_codes(spark.range(1, 4000).withColumnRenamed("id", "distance"), 100)


def codes_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.range(1, 5000).withColumnRenamed("id", "v")
    s, n, e = P.prefix_code(F.col("v"))
    return v.select("v", s.cast("int").alias("symbol"), n.cast("int").alias("bits"), e.cast("long").alias("extra"))


def tables_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.range(1, 257).select(F.col("id").cast("int").alias("v"))
    return v.select("v", P.quantizer_index(F.col("v")).alias("q"), P.rd_lambda(F.col("v")).alias("lambda"), P.probability_cost(F.col("v")).alias("cost"), P.reverse_bits(F.col("v").cast("long"), 9).alias("reversed"), P.near_lossless_value(P.clip(F.col("v")), 3).alias("near"))


QUERIES = [
    corpus_split_summary, corpus_distribution, corpus_grouping_sets, corpus_index, corpus_digest, match_by_size, match_by_quality, quality_aggregate, pareto_front, bd_comparison,
    timing_statistics, image_sums, image_entropy, image_hidden_rgb, image_yuv, image_predictors, image_colour_transform, image_near_lossless, image_distortion, image_ssim, image_chroma_planes,
    image_palette, image_palette_deltas, image_cache_hits, image_runs, image_offset_matches, image_activity, image_segments, image_huffman, image_identity, image_block_transforms, image_lossless, image_layout, image_candidates, image_lossy_curve, image_profiles, image_tile_entropy,
    image_block_predictors, image_hash_repeats, image_alpha_filters, codes_distance, codes_prefix,
    tables_quality,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*QUERIES, *coding.QUERIES]}


def oracle_sql() -> dict[str, str]:
    from pixelloom.plans import oracles

    return oracles.ORACLES | {f.__name__: sql for f, sql in coding.QUERIES.items() if sql} | coding.ORACLES | {"match_by_size": _nearest_sql(f"abs(r.bytes - l.bytes), {QD}"), "match_by_quality": _nearest_sql(f"{QD}, r.bytes")} | oracles.on_samples(SAMPLES_SQL)
