"""Reading image files with Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.operators import corpus

#: File name endings that count as images, in any case.
ENDINGS = ("jpg", "jpeg", "png")
#: Pixels that are unpacked at once.
CHUNK = 1 << 18


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, is_image) of all files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select("path", "length", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*ENDINGS).alias("is_image"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """The pixel table of all images that the JVM can decode; hidden colour under alpha 0 stays. img is the file's address.

    An image's bytes are unpacked as arrays, at most CHUNK pixels at once. Files that cannot be decoded have no pixels; unreadable() names them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for img, w, h, n, data in zip(*(b.column(c).to_pylist() for c in ("origin", "width", "height", "nChannels", "data"))):
                v = np.frombuffer(data, np.uint8).reshape(-1, n)
                for at in range(0, len(v), CHUNK):
                    part = v[at : at + CHUNK].astype(np.int32)
                    pos = np.arange(at, at + len(part))
                    blue, green, red = (part[:, 0],) * 3 if n == 1 else (part[:, k] for k in range(3))
                    alpha = part[:, 3] if n == 4 else np.full(len(part), 255, np.int32)
                    yield pa.RecordBatch.from_pydict({"img": [img] * len(part), "width": np.full(len(part), w, np.int32), "height": np.full(len(part), h, np.int32), "pos": pos, "x": pos % w, "y": pos // w, "r": red, "g": green, "b": blue, "a": alpha})

    i = spark.read.format("image").load(folder).where("image.width > 0").select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    return i.mapInArrow(run, "img string, width int, height int, pos long, x long, y long, r int, g int, b int, a int")


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """(img): files that the JVM cannot decode as images."""
    return spark.read.format("image").load(folder).where("image.width <= 0").select(F.col("image.origin").alias("img"))


def index(spark: SparkSession, folder: str, percent: int = 20) -> DataFrame:
    """One row an image file: digests of its bytes and of its pixels, size, alpha, format, and the split by its pixels' digest."""
    f = files(spark, folder).where("is_image").select("path", "length", F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))
    px = pixels(spark, folder)
    sizes = px.groupBy("img").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    ids = corpus.pixel_identity(px).withColumnRenamed("sha256", "pixel_sha256").join(sizes, "img")
    key = F.regexp_replace("path", "^file:/+", "/")
    j = f.withColumn("key", key).join(ids.withColumn("key", F.regexp_replace("img", "^file:/+", "/")), "key")
    return j.select(F.substring("sha256", 1, 16).alias("id"), "path", "length", "sha256", "pixel_sha256", "format", "width", "height", "has_alpha", P.holdout(F.col("pixel_sha256"), percent).alias("split")).orderBy("id", "sha256")


def kept(idx: DataFrame, split: str) -> DataFrame:
    """Rows of a split: train, holdout or all."""
    if split not in ("train", "holdout", "all"):
        raise ValueError("split must be train, holdout or all")
    return idx if split == "all" else idx.where(F.col("split") == split)


def chroma_at(luma: DataFrame, chroma: DataFrame, sx: int, sy: int) -> DataFrame:
    """Joins (img, x, y, ...) with chroma samples (img, cx, cy, cb, cr) taken every sx columns and sy rows."""
    return luma.withColumns({"cx": P.div(F.col("x"), sx), "cy": P.div(F.col("y"), sy)}).join(chroma, ["img", "cx", "cy"])
