"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier a bit separates the languages whose codeword has the bit from the
others by the mean log ratio of their byte 3-gram models. Decoding is loss-weighted: the codeword with the least sum of
logistic losses wins, each bit weighted by how well it is learned for that language. Two codewords at nearly the same loss
flag the document as ambiguous.

Training counts n-grams over all training rows where they lie. A bucket's weights are worked out where its counts meet, so
the driver gets 65,536 x bits weights, languages x bits shares and one row a language, however many rows or counts there are; bits are
at most 15 or 10 x log2 of the number of languages. The model is broadcast.

Defined cases: a null text, or one without a letter, is `und` with score 0 and not ambiguous; without any training
row every text is `und`; with one language every text with letters gets it; equal texts get equal predictions; of
languages at the same loss the first in alphabetic order wins; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.base import materialize, trimmed, whole_groups
from pixelloom.llm.ngrams import BUCKETS, grams

UNKNOWN = "und"
SMOOTHING = 0.5
SHARPNESS = 8.0
AMBIGUOUS_BELOW = 0.05


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1. Up to 5: every split of the languages in two once. More: the best of 200 random dense codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1.0 if i == n - 1 or not (s >> i) & 1 else -1.0 for s in range(1, 2 ** (n - 1))] for i in range(n)])
    rng, bits, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(c.sum(0)) == n).any():
            continue
        d = ((bits - c @ c.T) / 2 + np.eye(n) * bits).min()
        if d > apart:
            best, apart = c, d
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, rows sum to 1

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        g = grams(text, lower=True)
        margin = np.zeros(self.weights.shape[1])
        for i in range(0, len(g), 200_000):
            margin += self.weights[g[i : i + 200_000]].sum(axis=0, dtype=np.float64)
        loss = (self.trust * np.logaddexp(0.0, -SHARPNESS * self.code * (margin / len(g)))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(1.0 / p.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS_BELOW)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows whose text and language are not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                h = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                g = grams(text, lower=True)
                if len(g) > BUCKETS // 4:
                    h += np.bincount(g, minlength=BUCKETS)
                else:
                    np.add.at(h, g, 1)
        for lang, h in seen.items():
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(h[at], pa.int64())], ["lang", "bucket", "n"])

    d = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counted = d.mapInArrow(trimmed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "gram-counts")
    totals = sorted((r["lang"], r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # one row a language
    languages = [x for x, _ in totals]
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 1), np.float32), np.ones(code.shape))
    all_grams = np.array([n + SMOOTHING * BUCKETS for _, n in totals])
    place = {x: i for i, x in enumerate(languages)}
    plus, minus = (code > 0) / (code > 0).sum(axis=0), (code < 0) / (code < 0).sum(axis=0)
    sent = rows.sparkSession.sparkContext.broadcast((place, all_grams, plus, minus))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, all_grams, plus, minus = sent.value
        shares = np.zeros(plus.shape)
        for t in whole_groups(batches, "bucket"):
            lang = np.array([place[x] for x in t.column("lang").to_pylist()])
            bucket, at = np.unique(t.column("bucket").to_numpy(), return_inverse=True)
            n, step = t.column("n").to_numpy(), max(1, 4_000_000 // len(all_grams))
            for a in range(0, len(bucket), step):
                here = (at >= a) & (at < a + step)
                p = np.full((min(step, len(bucket) - a), len(all_grams)), SMOOTHING)
                p[at[here] - a, lang[here]] += n[here]
                p /= all_grams
                w = np.log(p @ plus) - np.log(p @ minus)
                shares += p.T @ w
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + step], pa.int32()), pa.array(list(w), pa.list_(pa.float64()))], ["key", "w"])
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(len(all_grams)), pa.int32()), pa.array(list(shares), pa.list_(pa.float64()))], ["key", "w"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = materialize(counted.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(weigh, "key int, w array<double>"), "gram-weights")
    absent = SMOOTHING / all_grams
    w = np.tile(np.log(absent @ plus) - np.log(absent @ minus), (BUCKETS, 1))
    found = np.zeros(BUCKETS, bool)
    got = weighed.where("key >= 0").toArrow()  # at most 65,536 rows
    if got.num_rows:
        at = got.column("key").to_numpy()
        w[at], found[at] = got.column("w").combine_chunks().flatten().to_numpy().reshape(len(at), -1), True
    shares = np.outer(absent, w[np.flatnonzero(~found)].sum(axis=0))
    for r in weighed.where("key < 0").select("key", F.posexplode("w")).groupBy("key", "pos").agg(F.sum("col").alias("s")).toLocalIterator():  # languages x bits
        shares[-1 - r["key"], r["pos"]] += r["s"]
    trust = np.maximum(code * shares, 1e-3)
    return Model(languages, code, w.astype(np.float32), trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column("text")]
            lang, score, open_ = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(open_, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(trimmed(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def cross_checked(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
