"""Quality classification by importance resampling.

Two hashed n-gram generative models are fitted: one on target text (labelled as good), one on the raw corpus. A document's
log weight is the mean over its n-grams of log p_target - log p_raw, times `STRENGTH`: the weight of a stretch of that many n-grams like
the document, so that long and short documents are sampled alike. Documents are drawn without replacement in proportion to their weights by
Gumbel top-k: each log weight gets a Gumbel noise that depends on the doc_id alone, and the k largest stay. k is given, or follows from
the share of documents to keep; unless that is given too, it is the share of good documents among the labelled ones.

The raw model counts all documents. The target model uses at most `TARGET_DOCS` documents labelled as good,
those with the smallest hash of their id; their ids are broadcast (8 bytes each).
Models are 65,538 counts. The k-th largest key is found exactly by histograms of the keys (rounds of at most 4,096 counts), not
by a global sort.

Defined cases: a null or empty text has log weight 0; documents whose key equals the k-th all stay; repeated rows with one
doc_id and text get one key; a document labelled both good and bad counts as bad; without target documents every weight is 0, and without
labels all documents stay; doc_ids are whole numbers; an empty table gives an empty result; extra columns are ignored by the scores and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.base import materialize, trimmed
from pixelloom.llm.ngrams import BUCKETS as GRAMS
from pixelloom.llm.ngrams import grams

TARGET_DOCS = 20_000
SMOOTHING = 1.0
#: N-grams that a log weight stands for.
STRENGTH = 64.0

#: Buckets: those of byte n-grams, then word pairs that repeat a word, then other word pairs.
BUCKETS = GRAMS + 2


def features(text: str) -> np.ndarray:
    """Buckets of a text's byte n-grams and, as the word bigrams that junk shows by itself, of its equal and unequal neighbouring words."""
    words = text.split()
    same = sum(map(eq, words, words[1:]))
    return np.concatenate([grams(text, lower=False), np.repeat(np.array([GRAMS, GRAMS + 1], np.uint32), [same, max(0, len(words) - 1 - same)])])


@dataclass
class Model:
    log_ratio: np.ndarray  # buckets
    share: float = 1.0  # of documents that are like the target

    def weight(self, text: str | None) -> float:
        return STRENGTH * float(self.log_ratio[features(text)].mean()) if text else 0.0


def fit(docs: DataFrame, labels: DataFrame, most: int = TARGET_DOCS) -> Model:
    """docs: doc_id, text. labels: doc_id, quality (1: good)."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    good, known = quality.agg(F.sum((F.col("q") == 1).cast("long")), F.count("*")).first()
    target = quality.where("q = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return Model(fit_ratio(docs, target), good / known if good else 1.0)


def fit_ratio(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of every bucket. good: the doc_ids of target documents, few enough to broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            held: list[np.ndarray] = []
            size = 0
            for text, target in zip(texts, b.column("target").to_pylist()):
                if text:
                    g = features(text)
                    held.append(g)
                    size += len(g)
                    if target:
                        np.add.at(h[1], g, 1)
                if size > 2_000_000:
                    h[0] += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                h[0] += np.bincount(np.concatenate(held), minlength=BUCKETS)
        for model in (0, 1):
            at = np.flatnonzero(h[model])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model), pa.int32()), pa.array(at, pa.int32()), pa.array(h[model][at], pa.int64())], ["model", "bucket", "n"])

    ids = good.withColumn("target", F.lit(True))
    d = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    got = d.mapInArrow(trimmed(count), "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toPandas()
    h = np.full((2, BUCKETS), SMOOTHING)
    h[got["model"], got["bucket"]] += got["n"]
    if not (got["model"] == 1).any():
        return np.zeros(BUCKETS)
    return np.log(h[1] / h[1].sum()) - np.log(h[0] / h[0].sum())


def log_weight(model: Model, text: Column, spark) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.weight(t) for t in texts], dtype="float64")

    return weigh(text)


def gumbel(doc_id: Column) -> Column:
    """Gumbel noise from the id: -log(-log(u)), u in (0, 1) from 52 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("gumbel")), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value of a double column, by histograms of 4,096 cells, each round within the cell that holds it."""
    if k < 1:
        return None
    lo_hi = df.agg(F.min(column), F.max(column), F.count(column)).first()
    lo, hi, n = lo_hi
    if not n:
        return None
    if k >= n:
        return lo
    above = 0
    while hi > lo:
        width = (hi - lo) / 4096
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        cell = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(4095)) if width > 0 else F.lit(0)
        got = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(got, key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


def threshold(scored: DataFrame, k: int | None, share: float) -> float | None:
    """The key of the last document that stays. scored: key."""
    return kth_largest(scored, "key", round(share * scored.count()) if k is None else k)


def scores(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, key, keep of every document."""
    d = docs.select("doc_id", "text")
    model = fit(d, labels)
    scored = d.select("doc_id", log_weight(model, F.col("text"), d.sparkSession).alias("log_weight")).withColumn("key", F.col("log_weight") + F.coalesce(gumbel(F.col("doc_id")), F.lit(0.0)))
    scored = materialize(scored, "weights")
    last = threshold(scored, k, model.share if share is None else share)
    return scored.withColumn("keep", F.col("key") >= last if last is not None else F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None) -> DataFrame:
    """The documents that stay, with all columns. Only the keys are stored; the filter weighs the texts where they lie."""
    d = docs.select("doc_id", "text")
    model = fit(d, labels)
    key = log_weight(model, F.col("text"), d.sparkSession) + F.coalesce(gumbel(F.col("doc_id")), F.lit(0.0))
    scored = materialize(d.select(key.alias("key")), "weights")
    last = threshold(scored, k, model.share if share is None else share)
    return docs.where(key >= last) if last is not None else docs.where(F.lit(False))
