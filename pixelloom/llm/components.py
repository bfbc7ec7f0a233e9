"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.base import drop, materialize


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] in place; label holds each item's smallest known class member, fully followed."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of each batch by stars with the same classes: no more rows than came in, and fewer rounds later."""
    for b in batches:
        ids, at = np.unique(np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()]), return_inverse=True)
        label = np.arange(len(ids))
        merge_labels(label, at[: b.num_rows], at[b.num_rows :])
        up = label != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[up]), pa.array(ids[label[up]])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node of its class.

    links: two columns of long node ids. Rounds aggregate before they shuffle, join on the aggregated minimum (which AQE can
    split when a node has very many links), go on until nothing changes, and are written to the shared folder, so no lineage grows and a lost executor
    costs one round at most.
    """
    a, b = links.columns
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = materialize(e.mapInArrow(_local_stars, "u long, v long").distinct(), "links")
    said = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        before, e = e, materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        drop(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == said:
            break
        said = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
