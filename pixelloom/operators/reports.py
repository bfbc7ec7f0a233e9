"""Reports as files: JSON lines, and images with a manifest of what they hold."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.operators import corpus, rate_distortion


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG file of 8-bit RGBA rows, each unfiltered."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.frombuffer(rgba, np.uint8).reshape(height, 4 * width)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def png_files(packed: DataFrame) -> DataFrame:
    """(img, width, height, png) of packed images; an image is one task's unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, p in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("argb")):
                v = p.values.to_numpy()
                out.append(png(w, h, np.stack([v >> s & 255 for s in (16, 8, 0, 24)], axis=1).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("img"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], ["img", "width", "height", "png"])

    return packed.select("img", "width", "height", "argb").mapInArrow(run, "img string, width int, height int, png binary")


def manifest(files: DataFrame, px: DataFrame) -> DataFrame:
    """(img, file, width, height, bytes, sha256, pixel_sha256, has_alpha): one row a file, with digests of its bytes and of its pixels."""
    own = files.select("img", F.concat("img", F.lit(".png")).alias("file"), "width", "height", F.octet_length("png").alias("bytes"), F.sha2("png", 256).alias("sha256"))
    return own.join(corpus.pixel_identity(px).withColumnRenamed("sha256", "pixel_sha256"), "img")


def write_json(report: DataFrame, out: str) -> None:
    """One JSON object a line; nulls are kept, so that all rows have the same keys."""
    report.write.option("ignoreNullFields", "false").json(out)


def rate_distortion_report(points: DataFrame, left: str, right: str) -> DataFrame:
    """One row: each side's points, the left ones matched on the right curve at equal size and at equal quality, and both mean differences.

    points: (fixture, encoder, log_rate, quality), one curve an encoder a fixture. Nothing is extrapolated.
    """
    good = points.where("log_rate IS NOT NULL AND quality IS NOT NULL")
    side = lambda e: good.where(F.col("encoder") == e)
    at = lambda x, y: rate_distortion.interpolated(side(right).select("fixture", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), side(left).select("fixture", F.col(x).cast("double").alias("target")))
    own = side(left).select("fixture", F.col("log_rate").cast("double").alias("log_rate"), F.col("quality").cast("double").alias("quality"))
    size = own.join(at("log_rate", "quality").where("value IS NOT NULL"), "fixture").where("log_rate = target").groupBy("fixture").agg(F.sort_array(F.collect_set(F.struct("log_rate", (F.col("quality") - F.col("value")).alias("gain")))).alias("matched_size"))
    quality = own.join(at("quality", "log_rate").where("value IS NOT NULL"), "fixture").where("quality = target").groupBy("fixture").agg(F.sort_array(F.collect_set(F.struct("quality", ((F.exp(F.col("log_rate") - F.col("value")) - 1) * 100).alias("percent")))).alias("matched_quality"))
    counts = good.groupBy("fixture").agg(F.count_if(F.col("encoder") == left).alias("left_points"), F.count_if(F.col("encoder") == right).alias("right_points"))
    return counts.join(size, "fixture", "left").join(quality, "fixture", "left").join(rate_distortion.bjontegaard(good, left, right), "fixture", "left")


def channel_planes(px: DataFrame) -> DataFrame:
    """(img, pos, luma, cb, cr): limited-range planes at full size."""
    cb, cr = P.chroma(F.col("r"), F.col("g"), F.col("b"))
    return px.select("img", "pos", P.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"), cb.alias("cb"), cr.alias("cr"))
