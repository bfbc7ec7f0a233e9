"""Indexing a corpus of files: identity, split, duplicates, and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P


def indexed(files: DataFrame, content: Column, percent: int = 20) -> DataFrame:
    """Adds sha256, id (its first 16 digits) and split."""
    sha = F.sha2(content.cast("binary"), 256)
    return files.withColumn("sha256", sha).withColumn("id", F.substring("sha256", 1, 16)).withColumn("split", P.holdout(F.col("sha256"), percent))


def floor_percentile(sorted_values: Column, percent: int) -> Column:
    """The element at floor((n - 1) * percent / 100)."""
    return F.element_at(sorted_values, (P.div((F.size(sorted_values) - 1) * percent, 100) + 1).cast("int"))


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, p50, p90, max by rank, exact and without a gathered list: counts of equal values are summed in order within each group."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(value) if by else Window.orderBy(value)
    placed = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when(F.col("upto") > P.div((F.col("total") - 1) * p, 100), F.col(value)))
    return placed.groupBy(*by).agg(F.min(value).alias("min"), at(50).alias("p50"), at(90).alias("p90"), F.max(value).alias("max"))


def summary(idx: DataFrame, size: str) -> DataFrame:
    """Files, distinct contents, duplicates, splits and total size."""
    return idx.agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("distinct_files"), (F.count("*") - F.count_distinct("sha256")).alias("duplicates"), F.count_if(F.col("split") == "holdout").alias("holdout"), F.count_if(F.col("split") == "train").alias("train"), F.sum(size).alias("total"))


def group_totals(idx: DataFrame, first: str, second: str, size: str) -> DataFrame:
    """Overall, by first, and by second."""
    g = idx.groupingSets([[], [F.col(first)], [F.col(second)]], F.col(first), F.col(second)).agg(F.count("*").alias("files"), F.sum(size).alias("total"), F.grouping_id().alias("grouping"))
    return g.select(first, second, "files", "total", "grouping")


def corpus_digest(idx: DataFrame) -> DataFrame:
    """SHA-256 over the sorted digests of a corpus, as a tree: digests of buckets by their first six hex digits, then of those by four, by two, and of all.

    A bucket of the lowest level holds one digest in 16 million; those above hold 256 at most.
    """
    parts = idx.select("sha256", F.col("sha256").alias("d"))
    for digits in (6, 4, 2, 0):
        own = F.substring("sha256", 1, digits) if digits else F.lit("")
        joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("sha256", "d"))), lambda s: s["d"]))
        parts = parts.groupBy(own.alias("bucket")).agg(F.sha2(joined, 256).alias("d")).withColumnRenamed("bucket", "sha256")
    return parts.select(F.col("d").alias("digest"))


def pixel_identity(px: DataFrame) -> DataFrame:
    """(img, sha256, has_alpha): digest over little-endian width and height and the RGBA bytes by rows."""
    le = lambda v: F.expr(f"unhex(concat(lpad(hex({v} % 256), 2, '0'), lpad(hex({v} DIV 256 % 256), 2, '0'), lpad(hex({v} DIV 65536 % 256), 2, '0'), lpad(hex({v} DIV 16777216), 2, '0')))")
    rgba = F.concat(*[F.lpad(F.hex(F.col(c)), 2, "0") for c in "rgba"])
    g = px.groupBy("img").agg(F.max("width").alias("w"), F.max("height").alias("h"), F.array_sort(F.collect_list(F.struct("pos", rgba.alias("v")))).alias("p"), F.bool_or(F.col("a") < 255).alias("has_alpha"))
    return g.select("img", F.sha2(F.concat(le("w"), le("h"), F.unhex(F.array_join(F.transform("p", lambda e: e["v"]), ""))), 256).alias("sha256"), "has_alpha")
