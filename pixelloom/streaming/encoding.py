"""Encoding files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelloom.operators import images

#: The rows of a stream of images: address, size, and packed pixels.
SCHEMA = "img string, width int, height int, argb array<long>, at timestamp"


def encoded(stream: DataFrame, mode: str = "fast") -> DataFrame:
    """(img, webp) of a stream of packed images; each micro-batch is encoded where its rows lie."""
    return images.encode(stream, mode)


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def sizes_by_window(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Images and pixels by event-time window; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("images"), F.sum(F.col("width") * F.col("height")).alias("pixels"))


def write(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
