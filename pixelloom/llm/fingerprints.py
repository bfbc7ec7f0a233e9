"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; from every window of w consecutive hashes the smallest is selected, the
rightmost among equals. Any passage of k + w - 1 code points that two texts share selects the same hash in both, at
positions that are kept. Texts shorter than a window select their smallest hash; texts shorter than k are one gram.

A text's neighbour (the next document by ascending id) is found without a global sort: ids are dealt into ranges, each
range is sorted in its own partition, and the first document of a range is also given to the range before.

Defined cases: a null or empty text has the empty fingerprint, and two empty fingerprints have likeness 1; equal texts have
equal fingerprints; rows with equal doc_id follow in the order of their texts; a null doc_id sorts first, and the last
document is followed by the one with the smallest id that is not null; ids are whole numbers; a single document is followed by itself; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.base import id_and_text, trimmed

GRAM, WINDOW = 9, 16
#: Fixed odd multipliers of the hash.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes (in uint64) of all k-grams: H(x + y) = H(x) * BASE^|y| + H(y), by doubling; then mixed."""
    h, n, out, have = points.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = BASE
    rest = k
    while True:
        if rest & 1:  # append this block of n to what is already covered
            out = h.copy() if out is None else out[: len(points) - have - n + 1] * power + h[have : have + len(points) - have - n + 1]
            have += n
        rest >>= 1
        if not rest:
            break
        h = h[:-n] * power + h[n:]
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        n *= 2
    out = out[: len(points) - k + 1]
    out ^= out >> _32
    out *= MIX
    return out >> _32


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return keys if n == w else np.minimum(keys[: len(keys) - (w - n)], keys[w - n :])


def winnow(points: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) selected from a text given as code points, by ascending position."""
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = gram_hashes(points, min(k, len(points)))
    # a larger position makes a smaller key: the rightmost of equal hashes wins
    keys = (h << _32) | (_LOW - np.arange(len(h), dtype=np.uint64))
    chosen = window_minima(keys, min(w, len(h)))
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    return (chosen >> _32).astype(np.uint32), (_LOW - (chosen & _LOW)).astype(np.int64)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(points: np.ndarray) -> np.ndarray:
    """The distinct selected hashes, ascending."""
    return np.unique(winnow(points)[0])


def as_string(fp: np.ndarray) -> str:
    return base64.b64encode(fp.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes in all hashes of the two."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def winnowed(docs: DataFrame, k: int = GRAM, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes array<long>, positions array<long>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [winnow(points_of(t.as_py()), k, w) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype(np.int64) for x, _ in got], pa.list_(pa.int64())), pa.array([y for _, y in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    d = id_and_text(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, hashes array<long>, positions array<long>")


def in_ranges(d: DataFrame) -> DataFrame:
    """Deals (doc_id, text) into sorted ranges. Rows with follows = 1 are only there to follow the last row of their range."""
    spark = d.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * n
    cuts = d.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first()["c"]
    cuts = sorted({int(c) for c in cuts or []})
    sent = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, ids.to_numpy(), side="right").astype(np.int32))

    d = d.withColumn("bucket", bucket(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))))
    # the first id of each range: as many rows as there are ranges
    heads = [(r["bucket"], r["head"]) for r in d.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("head")).orderBy("bucket").collect()]
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]  # the first head follows the last range
    own = F.struct("bucket", F.lit(0).alias("follows"))
    if before:
        to = spark.createDataFrame(before, "doc_id long, before int")
        d = d.join(F.broadcast(to), "doc_id", "left")
        copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("follows"))))
    else:
        copies = F.array(own)
    d = d.select("doc_id", "text", F.explode(copies).alias("c")).select("c.bucket", "c.follows", "doc_id", "text")
    return d.repartition(n, "bucket").sortWithinPartitions("bucket", "follows", "doc_id", "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and its follower's are.

    Edited: the last floor(n_chars / 4) code points give way to the first as many (or all) of the next document.
    """
    d = id_and_text(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(one: tuple, then: tuple) -> tuple:
        doc, text, points, fp = one
        cut = len(points) // 4
        kept = len(points) - cut
        edited = text[:kept] + then[1][:cut]
        efp = fingerprint(np.concatenate([points[:kept], then[2][:cut]]))
        return doc, len(points), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_string(fp), as_string(efp), likeness(fp, efp), likeness(fp, then[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        nothing = (None, "", np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        kinds = None
        for b in batches:
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out = []
            for bucket, follows, doc, text in zip(b.column("bucket").to_pylist(), b.column("follows").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                points = points_of(text)
                one = (doc, text, points, fingerprint(points))
                if waiting:
                    out.append(row(waiting[1], one if waiting[0] == bucket else nothing))
                waiting = None if follows else (bucket, one)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(waiting[1], nothing), kinds)], names)

    kind = d.schema["doc_id"].dataType.simpleString()
    return in_ranges(d).mapInArrow(trimmed(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
