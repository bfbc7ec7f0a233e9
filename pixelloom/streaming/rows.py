"""Images row by row: tokens that need two rows in memory, and the choice of a transform from what they cost.

Rows are (img, y, argb array<long>). They are dealt by image and sorted by y, so a task holds the last row and no more; this is the path of
images too large to be one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.functions import vp8l
from pixelloom.operators import histograms

TOKENS = "img string, y long, x int, length int, distance int, pixel long"


def rows(px: DataFrame) -> DataFrame:
    """(img, y, argb) of a pixel table."""
    p = px.select("img", "y", "x", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    return p.groupBy("img", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "p"))), lambda e: e["p"]).alias("argb"))


def without_green(image_rows: DataFrame) -> DataFrame:
    """Rows with green taken from red and blue."""

    def one(p):
        g = F.shiftright(p, 8).bitwiseAND(255)
        c = P.unpack(p)
        return p.bitwiseAND(0xFF00FF00).bitwiseOR(F.shiftleft(P.wrap(c["r"] - g.cast("int")).cast("long"), 16)).bitwiseOR(P.wrap(c["b"] - g.cast("int")).cast("long"))

    return image_rows.withColumn("argb", F.transform("argb", one))


def row_tokens(row: np.ndarray, above: np.ndarray | None, least: int = 4) -> list[tuple[int, int, int, int]]:
    """(x, length, distance, pixel) of a row: copies of the pixel before or of the row above, whichever goes further; single pixels have length 1 and distance 0."""
    n, out, x = len(row), [], 0

    def ends(same: np.ndarray) -> np.ndarray:
        """For each place where the run of sameness that holds it ends; the place itself where there is none."""
        stop = np.where(same, n, np.arange(n))
        return np.minimum.accumulate(stop[::-1])[::-1]

    left = ends(np.r_[False, row[1:] == row[:-1]])
    up = ends(row == above) if above is not None and len(above) == n else np.arange(n)
    while x < n:
        length, distance = max((int(left[x]) - x, 1), (int(up[x]) - x, n), key=lambda t: t[0])
        if length >= least:
            length = min(length, vp8l.MOST_LENGTH)
            out.append((x, length, distance, 0))
        else:
            length = 1
            out.append((x, 1, 0, int(row[x])))
        x += length
    return out


def tokens(image_rows: DataFrame, literal: bool = False) -> DataFrame:
    """(img, y, x, length, distance, pixel) of all rows; literal: single pixels only. An image stays in one task, which holds two of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        img, above = None, None
        for b in batches:
            out = []
            for i, y, p in zip(b.column("img").to_pylist(), b.column("y").to_pylist(), b.column("argb")):
                row = p.values.to_numpy()
                above = above if i == img else None
                found = [(x, 1, 0, int(v)) for x, v in enumerate(row)] if literal else row_tokens(row, above)
                out += [(i, y, *t) for t in found]
                img, above = i, row
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["img", "y", "x", "length", "distance", "pixel"])

    return image_rows.select("img", "y", "argb").repartition("img").sortWithinPartitions("img", "y").mapInArrow(run, TOKENS)


def token_histograms(found: DataFrame, width: int) -> DataFrame:
    """(img, alphabet, symbol, n, extra): counts of the five alphabets that tokens use, with their extra bits."""
    near = F.create_map(*[F.lit(v) for d, c in vp8l._near_codes(width).items() for v in (d, c)])
    code = F.coalesce(F.try_element_at(near, F.col("distance")), F.col("distance") + len(vp8l.NEAR))
    (ls, lb, _), (ds, db, _) = P.prefix_code(F.col("length")), P.prefix_code(code)
    c = P.unpack(F.col("pixel"))
    row = lambda a, s, e: F.struct(F.lit(a).alias("alphabet"), s.cast("int").alias("symbol"), e.cast("long").alias("extra"))
    none = F.lit(0)
    single = F.array(row("green", c["g"], none), row("red", c["r"], none), row("blue", c["b"], none), row("alpha", c["a"], none))
    copy = F.array(row("green", ls + vp8l.LITERALS, lb), row("distance", ds, db))
    parts = found.select("img", F.explode(F.when(F.col("distance") == 0, single).otherwise(copy)).alias("t"))
    return parts.groupBy("img", F.col("t.alphabet").alias("alphabet"), F.col("t.symbol").alias("symbol")).agg(F.count("*").alias("n"), F.sum("t.extra").alias("extra"))


def token_bits(found: DataFrame, width: int) -> DataFrame:
    """(img, bits): entropies of the alphabets and extra bits."""
    each = token_histograms(found, width).groupBy("img", "alphabet").agg(histograms.entropy(F.col("n")).alias("e"), F.sum("extra").alias("x"))
    return each.groupBy("img").agg(F.round(F.sum(F.col("e") + F.col("x")), 4).alias("bits"))


def plan(image_rows: DataFrame, width: int) -> DataFrame:
    """(img, transform, bits): with or without green, whichever takes fewer bits; without it if they are equal."""
    both = None
    for name, of in (("direct", image_rows), ("green", without_green(image_rows))):
        one = token_bits(tokens(of), width).withColumn("transform", F.lit(name))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("img").agg(F.min(F.struct("bits", "transform")).alias("b")).select("img", "b.transform", "b.bits")
