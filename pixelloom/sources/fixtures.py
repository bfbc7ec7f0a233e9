"""Synthetic images as pixel tables: (img, width, height, pos, x, y, r, g, b, a), one row a pixel, generated where it is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, width, height and the channel formulas of the standard images, in SQL with DIV for integer division.
STANDARD = [
    ("gradient128", 128, 128, "(x * 3 + y) % 256", "(x + y * 5) % 256", "(x * 7 + y * 11) % 256", "255"),
    ("ui256", 256, 256, "", "", "", "255"),
    ("flat128", 128, 128, "16", "32", "48", "255"),
    ("palette256", 256, 256, "c * 17", "(c * 37 + 19) % 256", "(c * 53 + 7) % 256", "255"),
    ("alpha128", 128, 128, "(x * 5 + y * 2) % 256", "(x * 3 + y * 7 + 11) % 256", "(x * 13 + y * 17 + 29) % 256", "64 + (x * 3 + y * 5) % 192"),
    ("photo512", 512, 512, "(c + x DIV 3 + y DIV 5) % 256", "(c + x DIV 7 + y DIV 2 + 17) % 256", "(c + x DIV 5 + y DIV 11 + 41) % 256", "255"),
]
#: The six colours of the interface image, by channel.
UI_COLOURS = {"r": [22, 36, 87, 210, 246, 48], "g": [27, 41, 166, 214, 248, 116], "b": [34, 47, 74, 220, 250, 190]}
#: Per image, the value c that its formulas share.
SHARED = {
    "ui256": "CASE WHEN x < 32 OR y < 25 THEN 0 WHEN (x DIV 24 + y DIV 18) % 7 = 0 THEN 2 WHEN (x DIV 48 + y DIV 32) % 5 = 0 THEN 5 WHEN (x + y) % 19 = 0 THEN 3 ELSE (x DIV 64 + y DIV 40) % 2 + 3 END",
    "palette256": "(x DIV 4 + y DIV 4 + x * y) % 16",
    "photo512": "(x * 37 + y * 53 + x * y * 3) % 256",
}


def _pick(channel: str) -> str:
    return "CASE c " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(UI_COLOURS[channel])) + " END"


def _formulas(name: str, r: str, g: str, b: str, a: str) -> tuple[str, str, str, str]:
    return (_pick("r"), _pick("g"), _pick("b"), a) if name == "ui256" else (r, g, b, a)


def image(spark: SparkSession, name: str, parts: int = 1) -> DataFrame:
    """One standard image. Its rows come from a range, so it can be as many partitions as wanted."""
    _, w, h, *channels = next(f for f in STANDARD if f[0] == name)
    p = spark.range(0, w * h, 1, parts).select(F.lit(name).alias("img"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.col("id").alias("pos"), (F.col("id") % w).alias("x"), F.expr(f"id DIV {w}").alias("y"))
    p = p.withColumn("c", F.expr(SHARED.get(name, "0")))
    values = [F.expr(f"CAST({e} AS INT)").alias(k) for k, e in zip("rgba", _formulas(name, *channels))]
    return p.select("img", "width", "height", "pos", "x", "y", *values)


def pixels(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [image(spark, f[0]) for f in STANDARD if names is None or f[0] in names])


def hidden_rgb(spark: SparkSession) -> DataFrame:
    """A 16 x 16 image whose transparent pixels carry colour."""
    p = spark.range(256).select(F.lit("hidden16").alias("img"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.col("id").alias("pos"), (F.col("id") % 16).alias("x"), F.expr("id DIV 16").alias("y"))
    return p.select("*", F.expr("CAST((x * 17 + 3) % 256 AS INT) r"), F.expr("CAST((y * 13 + 5) % 256 AS INT) g"), F.expr("CAST((x * y + 7) % 256 AS INT) b"), F.expr("CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE 255 END a"))


def with_aliases(spark: SparkSession) -> DataFrame:
    """The standard images and the one with hidden colour, as an exact comparison wants them."""
    return pixels(spark).unionByName(hidden_rgb(spark))


def verification(spark: SparkSession) -> DataFrame:
    """What an outside decoder is asked to read back: every image plain, the small ones with each kind of metadata, the translucent one with all.

    (img, variant, icc, exif, xmp): one row a file to make; metadata is null where the variant has none.
    """
    blob = {"icc": b"profile", "exif": b"exif data", "xmp": b"<x/>"}
    pick = lambda *names: tuple(blob[k] if k in names else None for k in blob)
    rows = [(f[0], "plain", *pick()) for f in STANDARD] + [("hidden16", "plain", *pick())]
    rows += [("flat128", "+".join(v), *pick(*v)) for v in (("icc",), ("exif",), ("xmp",), ("icc", "exif", "xmp"))]
    return spark.createDataFrame([*rows, ("alpha128", "icc+exif+xmp", *pick("icc", "exif", "xmp"))], "img string, variant string, icc binary, exif binary, xmp binary")


def comparison(spark: SparkSession, corpus_folder: str | None = None, split: str = "holdout", percent: int = 20, hidden: bool = False) -> DataFrame:
    """Pixels to compare encoders on: the standard images, or those of a split of a folder. hidden: with the one of hidden colour.

    'development' and 'validation' are other names of 'train' and 'holdout'.
    """
    if corpus_folder is None:
        return with_aliases(spark) if hidden else pixels(spark)
    from pixelloom.sources import images

    split = {"development": "train", "validation": "holdout"}.get(split, split)
    mine = images.kept(images.index(spark, corpus_folder, percent), split).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    px = images.pixels(spark, corpus_folder)
    return px.join(mine.distinct(), F.regexp_replace(px["img"], "^file:/+", "/") == mine["path"], "left_semi")


def pixels_sql(names: list[str] | None = None) -> str:
    """The same table as a DuckDB subquery."""
    parts = []
    for name, w, h, *channels in STANDARD:
        if names is None or name in names:
            r, g, b, a = (e.replace("DIV", "//") for e in _formulas(name, *channels))
            c = SHARED.get(name, "0").replace("DIV", "//")
            parts.append(f"SELECT '{name}' AS img, {w} AS width, {h} AS height, pos, x, y, CAST({r} AS INTEGER) AS r, CAST({g} AS INTEGER) AS g, CAST({b} AS INTEGER) AS b, CAST({a} AS INTEGER) AS a FROM (SELECT *, {c} AS c FROM (SELECT range AS pos, range % {w} AS x, range // {w} AS y FROM range({w * h})))")
    return " UNION ALL ".join(parts)
