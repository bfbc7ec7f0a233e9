"""Lossy analysis of whole images: planes from pixel tables, macroblock modes, and how quality follows the quantizer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.functions import vp8
from pixelloom.operators import stencils

FIELDS = "img string, q int, mbx int, mby int, mode int, chroma_mode int, nonzero int, distortion long, score long"


def planes(px: DataFrame, width: int, height: int) -> DataFrame:
    """(img, luma, cb, cr): one row an image, planes as arrays by rows."""
    y = px.select("img", "pos", P.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    c = stencils.chroma_planes(px, width, height).select("img", F.expr(f"cy * {(width + 1) // 2} + cx").alias("pos"), "cb", "cr")
    rows = lambda df, v: df.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", v))), lambda e: e[v]).alias(v))
    luma = rows(y, "v").withColumnRenamed("v", "luma")
    return luma.join(rows(c, "cb"), "img").join(rows(c, "cr"), "img")


def modes(images: DataFrame, width: int, height: int, quantizers: list[int]) -> DataFrame:
    """Macroblock choices of every image at every quantizer; each (image, quantizer) is decided on its own."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        r, q = t.iloc[0], int(t["q"].iloc[0])
        shape = lambda v, w: np.array(v, np.int64).reshape(-1, w)
        found, _ = vp8.decide(shape(r["luma"], width), shape(r["cb"], (width + 1) // 2), shape(r["cr"], (width + 1) // 2), q, q)
        return pd.DataFrame([(r["img"], q, c.mbx, c.mby, c.mode, c.chroma_mode, c.nonzero, c.distortion, c.score) for c in found], columns=[f.split()[0] for f in FIELDS.split(", ")])

    fan = images.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantizers])))
    return fan.groupBy("img", "q").applyInPandas(one, FIELDS)


def curve(choices: DataFrame) -> DataFrame:
    """(img, q, blocks, skipped, nonzero, psnr): totals of each quantizer over luma and chroma samples."""
    g = choices.groupBy("img", "q").agg(F.count("*").alias("blocks"), F.count_if(F.col("nonzero") == 0).alias("skipped"), F.sum("nonzero").alias("nonzero"), F.sum("distortion").alias("d"))
    return g.select("img", "q", "blocks", "skipped", "nonzero", F.round(P.psnr(F.col("d") / (F.col("blocks") * 384)), 4).alias("psnr"))
