"""Options of an encode as columns: modes and qualities resolved or refused, profiles by image statistics, and memory gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of modes, as users write them, and what they stand for.
MODES = {"default": "default", "fast": "fast", "balanced": "balanced", "best": "best", "best-compression": "best", "low-memory": "low-memory", "lossy-quality": "lossy-quality", "auto": "auto"}
#: Bytes of pixels that a buffered scan may hold, and the pixels of an image beyond which memory is saved.
SOURCE_BYTES, HUGE = 32 << 20, 4096 * 4096


def mode(name: Column) -> Column:
    """The mode a name stands for; null if it is none. Case and surrounding white space play no part."""
    named = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    return F.try_element_at(named, F.lower(F.trim(name)))


def quality(value: Column, default: int = 100) -> Column:
    """A quality from 1 to 100: the default for null, 0 and less, 100 for more."""
    return F.when(F.coalesce(value, F.lit(0)) <= 0, default).otherwise(F.least(value, F.lit(100)))


def qualities(text: Column) -> Column:
    """A comma-separated list of qualities, sorted and distinct; null if a part is no whole number from 1 to 100."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^[+-]?[0-9]+$"), p.try_cast("int")))
    good = F.forall(numbers, lambda n: F.coalesce((n >= 1) & (n <= 100), F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(numbers)))


def worker_bytes(pixels: Column, edges: Column) -> Column:
    """Memory of one search: candidate pixels, graph, parse and entropy state of each pixel, and a fixed share."""
    return pixels * (F.lit(44) + edges * 8) + (1 << 20)


def search_bytes(pixels: Column, edges: Column) -> Column:
    """Memory of a buffered search: the source plane and three screening buffers beside one worker."""
    return pixels * 16 + worker_bytes(pixels, edges)


def workers(pixels: Column, finalists: Column, edges: Column, most: int, memory: int) -> Column:
    """How many finalists may be refined at once, by counts and memory; one for small images."""
    each = worker_bytes(pixels, edges)
    few = (finalists < 2) | (pixels < 65536) | F.lit(most < 2) | (each > memory)
    return F.when(few, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(finalists, F.lit(most), F.floor(F.lit(memory) / each)))).cast("int")


def fits(pixels: Column, most: int = SOURCE_BYTES) -> Column:
    """Whether a scan may hold the whole plane at four bytes a pixel."""
    return pixels * 4 <= most


def auto_mode(pixels: Column, colours: Column, direct_bits: Column, palette_bits: Column, least_pixels: int = 65536) -> Column:
    """The mode that image statistics choose: huge images save memory, large ones of few colours that a palette shrinks well go fast."""
    small = (pixels >= least_pixels) & (colours <= 16) & (palette_bits * 4 <= direct_bits)
    return F.when(pixels >= HUGE, "low-memory").when(small, "fast").otherwise("balanced")


#: Search of the alpha plane by mode: filters to try, whether rows above are looked at, passes and pixels of the exact parse.
ALPHA = {
    "default": (["none", "horizontal", "vertical", "gradient"], True, 0, 1 << 20), "best": (["none", "horizontal", "vertical", "gradient"], True, 1, 4 << 20),
    "fast": (["none"], False, 0, 1 << 20), "low-memory": (["none", "horizontal", "vertical", "gradient"], False, 0, 1 << 20),
}


def alpha_profile(mode_name: Column) -> Column:
    """(filters, rows_above, passes, pixels) of a mode; unnamed modes are searched like the default one."""
    struct = lambda f, r, p, n: F.struct(F.array(*[F.lit(x) for x in f]).alias("filters"), F.lit(r).alias("rows_above"), F.lit(p).alias("passes"), F.lit(n).alias("pixels"))
    out = struct(*ALPHA["default"])
    for name in ("low-memory", "fast", "best"):
        out = F.when(mode_name == name, struct(*ALPHA[name])).otherwise(out)
    return out


def container_size(payload: Column, alpha: Column, icc: Column, exif: Column, xmp: Column) -> Column:
    """Bytes of a whole file; chunks are padded to even sizes, and what must be listed needs an extended header. Null beyond the format's limit."""
    chunk = lambda n: F.when(n > 0, n + n % 2 + 8).otherwise(0)
    extended = (icc > 0) | (exif > 0) | (xmp > 0) | (alpha > 0)
    total = F.lit(12) + F.when(extended, 18).otherwise(0) + chunk(icc) + chunk(alpha) + chunk(payload) + chunk(exif) + chunk(xmp)
    return F.when(total - 8 <= (1 << 32) - 10, total)


def extended_header(width: Column, height: Column, icc: Column, alpha: Column, exif: Column, xmp: Column) -> Column:
    """The extended header chunk as bytes: flags, then width and height less one in 24 bits each, lowest byte first."""
    flags = F.when(icc, 0x20).otherwise(0) + F.when(alpha, 0x10).otherwise(0) + F.when(exif, 0x08).otherwise(0) + F.when(xmp, 0x04).otherwise(0)
    three = lambda v: F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(255)), 2, "0") for k in range(3)])
    return F.unhex(F.concat(F.lit("56503858" + "0A000000"), F.lpad(F.hex(flags), 2, "0"), F.lit("000000"), three(width - 1), three(height - 1)))


def product(fixtures: DataFrame, qualities_: list[int], encoders: list[str]) -> DataFrame:
    """A row for each fixture, quality and encoder; the two lists are literals of the plan, so nothing is joined."""
    return fixtures.withColumn("quality", F.explode(F.array(*[F.lit(q) for q in sorted(set(qualities_))]))).withColumn("encoder", F.explode(F.array(*[F.lit(e) for e in encoders])))
