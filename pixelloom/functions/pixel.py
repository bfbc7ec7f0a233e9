"""Scalar pixel arithmetic as columns. Channels are integers; products that need 32 unsigned bits are longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: int | Column) -> Column:
    """Division that truncates toward zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def wrap(v: Column) -> Column:
    """Into 0..255."""
    return F.pmod(v, F.lit(256))


def clip(v: Column, lo: int = 0, hi: int = 255) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def argb(r: Column, g: Column, b: Column, a: Column) -> Column:
    big = [c.cast("long") for c in (a, r, g, b)]
    return F.shiftleft(big[0], 24).bitwiseOR(F.shiftleft(big[1], 16)).bitwiseOR(F.shiftleft(big[2], 8)).bitwiseOR(big[3])


def unpack(p: Column) -> dict[str, Column]:
    return {k: F.shiftright(p, s).bitwiseAND(255).cast("int") for k, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))}


def unpremultiply(c: Column, a: Column, most: int = 255) -> Column:
    """An alpha-premultiplied channel without its alpha, truncating; 0 where alpha is 0."""
    return F.when(a == 0, 0).otherwise(F.least(div(c * most, F.when(a == 0, 1).otherwise(a)), F.lit(most)))


def signed(c: Column) -> Column:
    """A byte as a number from -128 to 127."""
    return (c + 128) % 256 - 128


def colour_delta(t: Column, c: Column) -> Column:
    """Product of two signed bytes, over 32, rounding down."""
    return F.shiftright(signed(t) * signed(c), 5)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Limited-range luma."""
    return F.shiftright(r * 16839 + g * 33059 + b * 6420 + (1 << 15) + (16 << 16), 16)


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    cb = F.shiftright(r * -9719 - g * 19081 + b * 28800 + (1 << 15) + (128 << 16), 16)
    cr = F.shiftright(r * 28800 - g * 24116 - b * 4684 + (1 << 15) + (128 << 16), 16)
    return clip(cb), clip(cr)


def yuv_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    s = lambda c, k: F.shiftright(c * k, 8)
    base = s(y, 19077)
    return tuple(clip(F.shiftright(v, 6)) for v in (base + s(cr, 26149) - 14234, base - s(cb, 6419) - s(cr, 13320) + 8708, base + s(cb, 33050) - 17685))


def full_to_limited_luma(y: Column) -> Column:
    return div(y * 219 + 127, 255) + 16


def full_to_limited_chroma(c: Column) -> Column:
    size = div(F.abs(c - 128) * 224 + 127, 255)
    return F.when(c < 128, F.lit(128) - size).otherwise(size + 128)


def full_range_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Full-range BT.601 in 16-bit fixed point, as JPEG files use it."""
    y = F.shiftright(r * 19595 + g * 38470 + b * 7471 + (1 << 15), 16)
    cb = F.shiftright(r * -11056 - g * 21712 + b * 32768 + (257 << 15), 16)
    cr = F.shiftright(r * 32768 - g * 27440 - b * 5328 + (257 << 15), 16)
    return y, clip(cb), clip(cr)


def composite(v: Column, a: Column, background: Column | int) -> Column:
    """A channel over a background."""
    bg = F.lit(background) if isinstance(background, int) else background
    return div(v * a + bg * (F.lit(255) - a) + 127, 255)


def near_lossless_bits(quality: Column) -> Column:
    return F.when(quality >= 100, 0).otherwise(F.lit(5) - div(F.greatest(quality, F.lit(0)), 20))


def near_lossless_value(v: Column, bits: int) -> Column:
    """To the nearest multiple of 2^bits, ties to even, at most 255."""
    step = 1 << bits
    biased = v + (step - 1) // 2 + F.shiftright(v, bits) % 2
    return F.when(biased > 255, 255).otherwise(biased - biased % step) if step > 1 else v


def psnr(mse: Column) -> Column:
    """In dB; null for identical images."""
    return F.when(mse > 0, F.log10(F.lit(65025.0) / mse) * 10)


def ssim_db(s: Column) -> Column:
    return F.when(s < 1, F.log10(1 - s) * -10)


def quantizer_index(quality: Column) -> Column:
    """A quality from 1 to 100 as a quantizer index from 0 to 127."""
    c = clip(quality, 1, 100) / 100.0
    linear = F.when(c >= 0.75, c * 2 - 1).otherwise(c * (2.0 / 3.0))
    return clip(((F.lit(1) - F.cbrt(linear)) * 127).cast("int"), 0, 127)


def rd_lambda(q: Column) -> Column:
    q = F.greatest(q, F.lit(1)).cast("long")
    return F.greatest(div(q * q, 8), F.lit(1))


def probability_cost(p: Column) -> Column:
    """Cost in 1/256 bit of an event with probability p / 256."""
    return F.when(p <= 0, 1 << 30).otherwise((F.log2(F.lit(256.0) / F.greatest(p, F.lit(1))) * 256).cast("long"))


def quantize(v: Column, q: Column, bias: int = 128) -> Column:
    """A coefficient over its quantizer with a rounding bias of bias/256; magnitudes to 2047."""
    level = F.least(div(F.abs(v) * 256 + q * bias, q * 256), F.lit(2047))
    return F.when(q <= 0, 0).when(v < 0, -level).otherwise(level)


def prefix_code(v: Column) -> tuple[Column, Column, Column]:
    """(symbol, extra bits, extra) of a length or distance code from 1 on."""
    d = (v - 1).cast("long")
    top = F.when(d < 2, 0).otherwise(F.floor(F.log2(F.greatest(d, F.lit(1)).cast("double"))).cast("int"))
    # log2 of large integers may round up to the next power
    top = F.when(F.call_function("shiftleft", F.lit(1).cast("long"), top) > F.greatest(d, F.lit(1)), top - 1).otherwise(top)
    bits = F.greatest(top - 1, F.lit(0))
    second = F.call_function("shiftright", d, bits).bitwiseAND(1).cast("int")
    symbol = F.when(v <= 4, (v - 1).cast("int")).otherwise(top * 2 + second)
    extra = F.when(v <= 4, 0).otherwise(d.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1))
    return symbol, F.when(v <= 4, 0).otherwise(bits), extra


def palette_width_bits(size: Column) -> Column:
    """How many times a row of palette indexes can be halved."""
    return F.when(size <= 2, 3).when(size <= 4, 2).when(size <= 16, 1).otherwise(0)


def reverse_bits(v: Column, n: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), n, "0")), 2, 10).cast("long")


def cache_slot(p: Column, bits: int) -> Column:
    """Slot of a packed pixel in a colour cache of 2^bits."""
    return F.shiftright((p * 0x1E35A7BD).bitwiseAND(0xFFFFFFFF), 32 - bits)


def low32_product(a: Column, k: int) -> Column:
    """Lowest 32 bits of an unsigned product, in two halves so that nothing overflows a long."""
    lo, hi = k & 0xFFFF, k >> 16
    return (a * lo + F.shiftleft((a * hi).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def holdout(digest_hex: Column, percent: int) -> Column:
    """Split by the first 16 bits of a digest."""
    v = F.conv(F.substring(digest_hex, 1, 4), 16, 10).cast("long")
    return F.when(v * 100 < percent * 65536, "holdout").otherwise("train")


def metric_delta(a: Column, b: Column) -> Column:
    """Difference of two metrics where null means exact: both exact is 0, one exact is unknown."""
    return F.when(a.isNull() & b.isNull(), 0.0).otherwise(a - b)


def quality_distance(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), F.lit(1e6) - F.coalesce(a, b)).otherwise(F.abs(a - b))


def percent_delta(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise((a - b) * 100.0 / F.when(b == 0, 1).otherwise(b))
