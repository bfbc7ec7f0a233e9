"""Whole images as rows: packing pixel tables, encoding, decoding, and reading the layout of encoded files."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.functions import vp8l

MODES = tuple(vp8l.CHAINS)
LAYOUT = "img string, width int, height int, alpha boolean, transforms string, cache_bits int, groups int, literals long, copies long, cached long, header_bits long, code_bits long, data_bits long, total_bits long, bytes long"


def packed(px: DataFrame) -> DataFrame:
    """(img, width, height, argb array<long>): one row an image."""
    p = px.select("img", "width", "height", "pos", P.argb(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("p"))
    return p.groupBy("img", "width", "height").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda e: e["p"]).alias("argb"))


def encode(images: DataFrame, mode: str = "default") -> DataFrame:
    """(img, webp binary); icc, exif and xmp columns are embedded as they are. One image is one task's unit of work."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    extra = [c for c in ("icc", "exif", "xmp") if c in images.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = [vp8l.container(vp8l.encode(np.asarray(r.argb).tolist(), int(r.width), int(r.height), mode), **{c: getattr(r, c) for c in extra}) for r in t.itertuples()]
            yield pd.DataFrame({"img": t["img"], "webp": out})

    return images.select("img", "width", "height", "argb", *extra).mapInPandas(run, "img string, webp binary")


def candidates(images: DataFrame, mode: str = "best") -> DataFrame:
    """(img, candidate, bits): exact size of every transform chain; chains of an image are spread over tasks."""
    chains = list(enumerate([*vp8l.CHAINS[mode], ("palette",)]))
    by_number = dict(chains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for r in t.itertuples():
                p, chain = np.asarray(r.argb).tolist(), by_number[r.candidate]
                if chain != ("palette",) or len(set(p)) <= 256:
                    rows.append((r.img, r.candidate, vp8l._payload(p, int(r.width), int(r.height), chain, 0, False).count))
            yield pd.DataFrame(rows, columns=["img", "candidate", "bits"])

    fan = images.withColumn("candidate", F.explode(F.array(*[F.lit(i) for i, _ in chains]))).repartition("img", "candidate")
    return fan.select("img", "width", "height", "argb", "candidate").mapInPandas(run, "img string, candidate int, bits long")


def best_candidate(scored: DataFrame) -> DataFrame:
    """The fewest bits; the first of equals."""
    return scored.groupBy("img").agg(F.min_by("candidate", F.struct("bits", "candidate")).alias("candidate"), F.min("bits").alias("bits"))


def decode(files: DataFrame) -> DataFrame:
    """(img, width, height, pos, x, y, r, g, b, a) of lossless files given as (img, webp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for img, data in zip(b.column("img").to_pylist(), b.column("webp").to_pylist()):
                stream = next(c for n, c in vp8l.chunks(data) if n == "VP8L")
                w, h, p, _ = vp8l.decode(stream)
                v, pos = np.array(p, np.int64), np.arange(w * h)
                cols = {"img": pa.array([img] * len(p), pa.string()), "width": pa.array(np.full(len(p), w), pa.int32()), "height": pa.array(np.full(len(p), h), pa.int32()), "pos": pa.array(pos), "x": pa.array(pos % w), "y": pa.array(pos // w)}
                cols |= {k: pa.array((v >> s & 255).astype(np.int32)) for k, s in (("r", 16), ("g", 8), ("b", 0), ("a", 24))}
                yield pa.RecordBatch.from_pydict(cols)

    return files.select("img", "webp").mapInArrow(run, "img string, width int, height int, pos long, x long, y long, r int, g int, b int, a int")


def layout(files: DataFrame) -> DataFrame:
    """What the bits of each lossless file are for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for r in t.itertuples():
                _, _, _, lay = vp8l.decode(next(c for n, c in vp8l.chunks(r.webp) if n == "VP8L"))
                rows.append((r.img, lay.width, lay.height, lay.alpha, ",".join(map(str, lay.transforms)), lay.cache_bits, lay.groups, lay.literals, lay.copies, lay.cached, lay.header_bits, lay.code_bits, lay.data_bits, lay.total_bits, len(r.webp)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in LAYOUT.split(", ")])

    return files.select("img", "webp").mapInPandas(run, LAYOUT)


def timed(images: DataFrame, mode: str = "default", runs: int = 3) -> DataFrame:
    """(img, run, ns, bytes, sha256): a warm-up, then timed encodes whose output must not differ from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for t in batches:
            rows = []
            for r in t.itertuples():
                p = np.asarray(r.argb).tolist()
                first = vp8l.encode(p, int(r.width), int(r.height), mode)
                for n in range(runs):
                    start = time.perf_counter_ns()
                    again = vp8l.encode(p, int(r.width), int(r.height), mode)
                    rows.append((r.img, n, time.perf_counter_ns() - start, len(again), hashlib.sha256(again).hexdigest()))
                    if again != first:
                        raise ValueError("encoding is not deterministic")
            yield pd.DataFrame(rows, columns=["img", "run", "ns", "bytes", "sha256"])

    return images.select("img", "width", "height", "argb").mapInPandas(run, "img string, run int, ns long, bytes long, sha256 string")
