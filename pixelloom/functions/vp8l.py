"""Lossless WebP: writing and reading one image's VP8L stream and its RIFF container. Bits go lowest first.

Each part is sequential within an image, so images are the unit of parallel work.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np

from pixelloom.operators.histograms import code_lengths

#: Fixed values of the format.
SIGNATURE, LITERALS, LENGTHS, DISTANCES = 0x2F, 256, 24, 40
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, COLOUR, GREEN, PALETTE = range(4)
MOST_LENGTH = 4096
#: Near neighbours, nearest first: up to 7 rows up and from 7 to the right to 8 to the left.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """A stream of bits that counts, and keeps what it counts unless told otherwise."""

    def __init__(self, keep: bool = True):
        self.keep, self.held, self.filled, self.count, self.out = keep, 0, 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.count += n
        if self.keep:
            self.held |= value << self.filled
            self.filled += n
            while self.filled >= 8:
                self.out.append(self.held & 255)
                self.held >>= 8
                self.filled -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.held]) if self.filled else b"")


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return v


def prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, extra) of a length or distance code from 1 on."""
    if value <= 4:
        return value - 1, 0, 0
    d = value - 1
    n = d.bit_length() - 2
    return 2 * (n + 1) + (d >> n & 1), n, d & (1 << n) - 1


def unprefix(symbol: int, reader: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + reader.get(n) + 1


def distance_code(distance: int, width: int) -> int:
    codes = _near_codes(width)
    return codes.get(distance, distance + len(NEAR))


_CODES: dict[int, dict[int, int]] = {}


def _near_codes(width: int) -> dict[int, int]:
    if width not in _CODES:
        found: dict[int, int] = {}
        for i, (x, y) in enumerate(NEAR):
            found.setdefault(max(x + y * width, 0), i + 1)
        found.pop(0, None)
        _CODES[width] = found
    return _CODES[width]


def undistance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(x + y * width, 1)


class Codes:
    """A prefix code over one alphabet: codes by symbol, written lowest bit first."""

    def __init__(self, counts: Counter, size: int):
        self.size = size
        self.lengths = code_lengths(counts) if counts else {0: 1}
        if len(self.lengths) == 1 and max(self.lengths) > 255:  # a second, unused symbol completes the code
            self.lengths[0] = 1
        self.single = len(self.lengths) == 1
        self.codes, code, before = {}, 0, 0
        for n, s in sorted((n, s) for s, n in self.lengths.items()):
            code <<= n - before
            self.codes[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
            code, before = code + 1, n

    def put(self, bits: Bits, symbol: int) -> None:
        if not self.single:
            bits.put(*self.codes[symbol])

    def write(self, bits: Bits) -> None:
        live = sorted(self.lengths)
        if len(live) <= 2 and live[-1] < 256:
            bits.put(1, 1)
            bits.put(len(live) - 1, 1)
            wide = live[0] > 1
            bits.put(wide, 1)
            bits.put(live[0], 8 if wide else 1)
            if len(live) == 2:
                bits.put(live[1], 8)
            return
        bits.put(0, 1)
        tokens = self._runs()
        lengths = _shallow(tokens)
        n = max(4, max(i for i, s in enumerate(CODE_ORDER) if lengths.get(s)) + 1)
        bits.put(n - 4, 4)
        for s in CODE_ORDER[:n]:
            bits.put(lengths.get(s, 0), 3)
        bits.put(0, 1)
        coder = _from_lengths(lengths)
        for t, extra, width in tokens:
            if len(coder) > 1:
                bits.put(*coder[t])
            bits.put(extra, width)

    def _runs(self) -> list[tuple[int, int, int]]:
        """Code lengths as tokens; runs of zeros and repeats are shortened."""
        values, out, i, last = [self.lengths.get(s, 0) for s in range(self.size)], [], 0, 8
        while i < len(values):
            v, n = values[i], 1
            while i + n < len(values) and values[i + n] == v:
                n += 1
            i += n
            if v == 0:
                while n >= 11:
                    k = min(n, 138)
                    out.append((18, k - 11, 7))
                    n -= k
                if n >= 3:
                    out.append((17, n - 3, 3))
                    n = 0
                out += [(0, 0, 0)] * n
            else:
                if v != last:
                    out.append((v, 0, 0))
                    last, n = v, n - 1
                while n >= 3:
                    k = min(n, 6)
                    out.append((16, k - 3, 2))
                    n -= k
                out += [(v, 0, 0)] * n
        return out


def _shallow(tokens: list) -> dict[int, int]:
    """Lengths of the code over code lengths, at most 7 deep."""
    counts = Counter(t for t, _, _ in tokens)
    return code_lengths(counts, 7) if len(counts) > 1 else dict.fromkeys(counts, 1)


def _from_lengths(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - before
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code, before = code + 1, n
    return out


def _read_codes(reader: Reader, size: int) -> dict[tuple[int, int], int]:
    """{(length, code): symbol}; a lone symbol takes no bits."""
    if reader.get(1):
        two, wide = reader.get(1), reader.get(1)
        symbols = [reader.get(8 if wide else 1)]
        if two:
            symbols.append(reader.get(8))
        return {(0, 0): symbols[0]} if not two else {(1, i): s for i, s in enumerate(sorted(symbols))}
    first = {CODE_ORDER[i]: n for i in range(reader.get(4) + 4) if (n := reader.get(3))}
    inner = _table(first)
    left = size if not reader.get(1) else 2 + reader.get(2 + 2 * reader.get(3))
    lengths: dict[int, int] = {}
    at, last = 0, 8
    while at < size and left:
        left -= 1
        t = _symbol(reader, inner)
        if t < 16:
            if t:
                lengths[at] = last = t
            at += 1
        elif t == 16:
            for _ in range(3 + reader.get(2)):
                lengths[at] = last
                at += 1
        else:
            at += 3 + reader.get(3) if t == 17 else 11 + reader.get(7)
    if at > size:
        raise ValueError("code lengths go beyond the alphabet")
    return _table(lengths)


def _table(lengths: dict[int, int]) -> dict[tuple[int, int], int]:
    if len(lengths) == 1:
        return {(0, 0): next(iter(lengths))}
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        out[n, code] = s
        code, before = code + 1, n
    return out


def _symbol(reader: Reader, table: dict[tuple[int, int], int]) -> int:
    if (0, 0) in table:
        return table[0, 0]
    code = 0
    for n in range(1, 16):
        code = code << 1 | reader.get(1)
        if (n, code) in table:
            return table[n, code]
    raise ValueError("no such code")


@dataclass
class Layout:
    """What the bits of a stream are for."""

    width: int = 0
    height: int = 0
    alpha: bool = False
    transforms: list[int] = field(default_factory=list)
    cache_bits: int = 0
    groups: int = 0
    literals: int = 0
    copies: int = 0
    cached: int = 0
    header_bits: int = 0
    code_bits: int = 0
    data_bits: int = 0
    total_bits: int = 0


def copies_of(p: list[int], width: int, depth: int = 16) -> list[tuple[int, int, int]]:
    """Greedy parse as (place, length, distance); distance 0 stands for single pixels.

    Places with the same three pixels are tried from the last one back, after the pixel before and the one above; a match is measured
    as arrays, and only if it would be longer than the best so far.
    """
    q, n = np.array(p, np.uint32), len(p)
    key = np.zeros(n, np.uint64)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        key[: max(0, n - 2)] += q[k : max(k, n - 2 + k)].astype(np.uint64) * np.uint64(factor)
    keys, chains, out, i, single = key.tolist(), defaultdict(list), [], 0, 0
    while i < n:
        best, at = 0, 0
        if i + 3 < n:
            most = min(MOST_LENGTH, n - i)
            for j in (*((i - d) for d in (1, width) if i >= d), *reversed(chains.get(keys[i], ())[-depth:])):
                if best < most and p[j] == p[i] and p[j + best] == p[i + best] and p[j + 2] == p[i + 2]:
                    short = 16 if most > 16 and p[j + 15] != p[i + 15] else most
                    apart = q[j : j + short] != q[i : i + short]
                    k = int(apart.argmax())
                    k = k if apart[k] else short
                    if k > best:
                        best, at = k, j
                        if k == most:
                            break
        step = best if best >= 4 else 1
        if step > 1:
            if single:
                out.append((i - single, single, 0))
                single = 0
            out.append((i, step, i - at))
        else:
            single += 1
        for k in range(i, min(i + step, n - 2)):
            chains[keys[k]].append(k)
        i += step
    if single:
        out.append((n - single, single, 0))
    return out


def with_cache(p: list[int], copies: list[tuple[int, int, int]], cache_bits: int) -> list[tuple]:
    """Tokens of a parse: ('c', length, distance), ('k', slot) or ('l', pixel)."""
    out: list[tuple] = []
    if not cache_bits:
        for at, n, distance in copies:
            if distance:
                out.append(("c", n, distance))
            else:
                out += [("l", v) for v in p[at : at + n]]
        return out
    slots = ((np.array(p, np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).tolist()
    cache: list[int] = [0] * (1 << cache_bits)
    for at, n, distance in copies:
        if distance:
            out.append(("c", n, distance))
            for k in range(at, at + n):
                cache[slots[k]] = p[k]
        else:
            for k in range(at, at + n):
                s, v = slots[k], p[k]
                out.append(("k", s) if cache[s] == v else ("l", v))
                cache[s] = v
    return out


def tokens_of(p: list[int], width: int, cache_bits: int, depth: int = 16) -> list[tuple]:
    return with_cache(p, copies_of(p, width, depth), cache_bits)


def token_bits(tokens: list[tuple], width: int) -> float:
    """About how many bits tokens take: entropies of the five alphabets, extra bits, and a few bits a symbol for the codes."""
    literal = np.array([t[1] for t in tokens if t[0] == "l"], np.uint32)
    copies = [(prefix(t[1]), prefix(distance_code(t[2], width))) for t in tokens if t[0] == "c"]
    green = np.r_[literal >> 8 & 255, np.array([LITERALS + n[0] for n, _ in copies], np.uint32), np.array([LITERALS + LENGTHS + t[1] for t in tokens if t[0] == "k"], np.uint32)]
    total = float(sum(n[1] + d[1] for n, d in copies))
    for v in (green, literal >> 16 & 255, literal & 255, literal >> 24, np.array([d[0] for _, d in copies], np.uint32)):
        n = np.bincount(v.astype(np.int64)) if len(v) else np.zeros(1)
        n = n[n > 0].astype(float)
        if len(n) > 1:
            total += float((n * (np.log2(n.sum()) - np.log2(n))).sum()) + 5 * len(n)
    return total


def put_image(bits: Bits, p: list[int], width: int, cache_bits: int = 0, main: bool = False, tokens: list[tuple] | None = None) -> None:
    """One entropy-coded image with one group of codes; its tokens may be known already."""
    bits.put(1 if cache_bits else 0, 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)
    counts, coded = [Counter() for _ in range(5)], []
    for t in tokens_of(p, width, cache_bits) if tokens is None else tokens:
        if t[0] == "l":
            g, r, b, a = t[1] >> 8 & 255, t[1] >> 16 & 255, t[1] & 255, t[1] >> 24
            parts = [(0, g), (1, r), (2, b), (3, a)]
        elif t[0] == "k":
            parts = [(0, LITERALS + LENGTHS + t[1])]
        else:
            s, n, e = prefix(t[1])
            d, m, f = prefix(distance_code(t[2], width))
            parts = [(0, LITERALS + s), (None, e, n), (4, d), (None, f, m)]
        for q in parts:
            if q[0] is not None:
                counts[q[0]][q[1]] += 1
        coded.append(parts)
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [Codes(c, n) for c, n in zip(counts, sizes)]
    for c in codes:
        c.write(bits)
    for parts in coded:
        for q in parts:
            if q[0] is None:
                bits.put(q[1], q[2])
            else:
                codes[q[0]].put(bits, q[1])


def _sub(a: int, b: int) -> int:
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def residuals(p: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What a predictor leaves of a whole image (packed pixels), per channel and wrapped."""
    f = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4).astype(np.int16)
    n, guess = len(f), np.empty((len(f), 4), np.int16)
    guess[0] = (0, 0, 0, 255)
    guess[1:width] = f[: min(width, n) - 1]
    if n > width:
        left, top, right, corner = f[width - 1 : -1], f[:-width], f[1 : n - width + 1], np.concatenate([f[:1], f[: n - width - 1]])
        half = lambda x, y: (x + y) >> 1
        if mode == 0:
            g = np.broadcast_to(guess[0], left.shape)
        elif mode <= 4:
            g = (left, top, right, corner)[mode - 1]
        elif mode <= 10:
            x, y = {5: (half(left, right), top), 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right), 10: (half(left, corner), half(top, right))}[mode]
            g = half(x, y)
        elif mode == 11:
            g = np.where((np.abs(top - corner).sum(axis=1) < np.abs(left - corner).sum(axis=1))[:, None], left, top)
        elif mode == 12:
            g = np.clip(left + top - corner, 0, 255)
        else:
            mean = half(left, top)
            g = np.clip(mean + ((mean - corner + (mean < corner)) >> 1), 0, 255)
        guess[width:] = g
        guess[width::width] = f[: n - width : width]
    return np.ascontiguousarray((f - guess).astype(np.uint8)).view("<u4").reshape(-1)


def green_left(p: np.ndarray) -> np.ndarray:
    """Red and blue without green."""
    green = p >> 8 & 255
    return (p & 0xFF00FF00) | ((p >> 16) - green & 255) << 16 | (p - green & 255)


def chained(p: np.ndarray, width: int, chain: tuple) -> np.ndarray:
    """The pixels after a chain of 'green' and ('predict', mode)."""
    for step in chain:
        p = green_left(p) if step == "green" else residuals(p, width, step[1])
    return p


def screened_bits(p: np.ndarray, width: int) -> float:
    """About what pixels cost: entropies of those that differ from the one before, and from those one and two rows above, and a bit for each 64 of the others."""
    same = np.zeros(len(p), bool)
    for d in (1, width, 2 * width):
        if d < len(p):
            same[d:] |= p[d:] == p[:-d]
    left, total = p[~same], same.sum() / 64
    for shift in (0, 8, 16, 24):
        n = np.bincount((left >> shift & 255).astype(np.int64), minlength=1)
        n = n[n > 0].astype(float)
        total += float((n * (np.log2(max(1.0, n.sum())) - np.log2(n))).sum()) + 5 * len(n)
    return total


def _add(a: int, b: int) -> int:
    return sum(((a >> s & 255) + (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def _by_channel(f, *v: int) -> int:
    return sum(f(*(x >> s & 255 for x in v)) << s for s in (0, 8, 16, 24))


def _half(a: int, b: int) -> int:
    return _by_channel(lambda x, y: (x + y) // 2, a, b)


def predicted(p: list[int], i: int, width: int, mode: int) -> int:
    x = i % width
    if i == 0:
        return 0xFF000000
    if i < width:
        return p[i - 1]
    if x == 0:
        return p[i - width]
    left, top, tr, tl = p[i - 1], p[i - width], p[i - width + 1], p[i - width - 1]
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode < 5:
        return (left, top, tr, tl)[mode - 1]
    if mode == 11:
        pick = lambda q: sum(abs((left >> s & 255) + (top >> s & 255) - (tl >> s & 255) - (q >> s & 255)) for s in (0, 8, 16, 24))
        return left if pick(left) < pick(top) else top
    if mode == 12:
        return _by_channel(lambda a, b, c: min(255, max(0, a + b - c)), left, top, tl)
    if mode == 13:
        return _by_channel(lambda a, b: min(255, max(0, a + int((a - b) / 2))), _half(left, top), tl)
    return {5: lambda: _half(_half(left, tr), top), 6: lambda: _half(left, tl), 7: lambda: _half(left, top), 8: lambda: _half(tl, top), 9: lambda: _half(top, tr), 10: lambda: _half(_half(left, tl), _half(top, tr))}[mode]()


def _signed(v: int) -> int:
    return (v + 128) % 256 - 128


def _payload(p: list[int], width: int, height: int, chain: tuple, cache_bits: int, keep: bool, tokens: list[tuple] | None = None) -> Bits:
    """The stream with a chain of transforms: 'green', ('predict', mode) or 'palette'. tokens: those of the last image, if they are known."""
    bits = Bits(keep)
    bits.put(SIGNATURE, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(any(v >> 24 != 255 for v in p), 1)
    bits.put(0, 3)
    q = np.array(p, np.uint32)
    for step in chain:
        bits.put(1, 1)
        if step == "green":
            bits.put(GREEN, 2)
            q = green_left(q)
        elif step == "palette":
            table, at = np.unique(q, return_inverse=True)
            bits.put(PALETTE, 2)
            bits.put(len(table) - 1, 8)
            colours = table.tolist()
            put_image(bits, [_sub(v, colours[i - 1] if i else 0) for i, v in enumerate(colours)], len(colours))
            q, width = bundled(at.reshape(height, width), len(table))
        else:
            bits.put(PREDICTOR, 2)
            size = 9
            bits.put(size - 2, 3)
            w, h = (width + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            put_image(bits, [0xFF000000 | step[1] << 8] * (w * h), w)
            q = residuals(q, width, step[1])
    bits.put(0, 1)
    put_image(bits, q.tolist(), width, cache_bits, True, tokens)
    return bits


def bundled(index: np.ndarray, colours: int) -> tuple[np.ndarray, int]:
    """(pixels, width) of palette indexes by rows, 1 to 8 to a pixel, the first in the lowest bits of green."""
    k = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    height, width = index.shape
    wide = -(-width >> k) if k else width
    padded = np.zeros((height, wide << k), np.uint32)
    padded[:, :width] = index
    packed = np.zeros((height, wide), np.uint32)
    for j in range(1 << k):
        packed |= padded[:, j :: 1 << k] << np.uint32((8 >> k) * j)
    return (packed << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1), wide


_MODES = (1, 2, 12, 3, 7, 11)
#: Chains that each mode looks at: the fast one none but a palette, the best one every predictor.
CHAINS = {
    "fast": [()], "default": [(), ("green",), *[c for m in _MODES for c in ((("predict", m),), ("green", ("predict", m)))]], "low-memory": [(), ("green",)],
    "best": [(), ("green",), *[c for m in range(1, 14) for c in ((("predict", m),), ("green", ("predict", m)))]],
}
#: Chains whose pixels are parsed, of those with the least screened bits; places tried for a match; cache sizes.
FINALISTS = {"fast": 1, "default": 3, "low-memory": 2, "best": 5}
DEPTH = {"fast": 4, "default": 16, "low-memory": 8, "best": 64}
CACHES = {"fast": (0,), "default": (0, *range(1, 12)), "low-memory": (0, 6), "best": (0, *range(1, 12))}


def encode(p: list[int], width: int, height: int, mode: str = "default") -> bytes:
    """Of the mode's chains the one that takes the fewest bits; the first of equals.

    All chains are screened as arrays; the best are parsed once each, and all cache sizes are weighed on the best parse.
    """
    if not (1 <= width <= 16384 and 1 <= height <= 16384 and len(p) == width * height):
        raise ValueError("width and height must be from 1 to 16384 and match the pixels")
    q, plans = np.array(p, np.uint32), []
    screened = [(screened_bits(pixels, width), i, chain, pixels) for i, chain in enumerate(CHAINS[mode]) for pixels in [chained(q, width, chain)]]
    screened = sorted(screened, key=lambda t: t[:2])[: FINALISTS[mode]]
    finalists = [(bits, chain, pixels, width) for bits, _, chain, pixels in screened if bits <= 2 * screened[0][0]]
    colours = np.unique(q)
    if len(colours) <= 256:
        pixels, wide = bundled(np.searchsorted(colours, q).reshape(height, width), len(colours))
        finalists.append((screened_bits(pixels, wide), ("palette",), pixels, wide))
    least = min(bits for bits, *_ in finalists)
    for _, chain, pixels, wide in [f for f in finalists if f[0] <= 2 * least]:
        values = pixels.tolist()
        copies = copies_of(values, wide, DEPTH[mode])
        tokens = with_cache(values, copies, 0)
        own = 16 * len(colours) if chain == ("palette",) else 20 * len(chain)
        plans.append((token_bits(tokens, wide) + own, len(plans), chain, 0, tokens, values, copies, wide, own))
    _, _, chain, _, _, values, copies, wide, own = min(plans, key=lambda t: t[:2])
    if sum(n for _, n, d in copies if not d) > 64:
        for bits in CACHES[mode][1:]:
            tokens = with_cache(values, copies, bits)
            plans.append((token_bits(tokens, wide) + own, len(plans), chain, bits, tokens))
    best = min(plans, key=lambda t: t[:2])
    return _payload(p, width, height, best[2], best[3], True, best[4]).done()


def _get_image(r: Reader, width: int, height: int, lay: Layout, main: bool) -> list[int]:
    cache_bits = r.get(4) if r.get(1) else 0
    groups, meta, meta_bits = 1, None, 0
    if main and r.get(1):
        meta_bits = r.get(3) + 2
        w = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = [v >> 8 & 0xFFFF for v in _get_image(r, w, (height + (1 << meta_bits) - 1) >> meta_bits, Layout(), False)]
        groups = max(meta) + 1
    start = r.at
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[_read_codes(r, n) for n in sizes] for _ in range(groups)]
    if main:
        lay.cache_bits, lay.groups, lay.code_bits = cache_bits, groups, r.at - start
    start, out, cache = r.at, [], {}
    n, w = width * height, (width + (1 << meta_bits) - 1) >> meta_bits if meta else 0
    while len(out) < n:
        i = len(out)
        g = codes[meta[(i // width >> meta_bits) * w + (i % width >> meta_bits)] if meta else 0]
        s = _symbol(r, g[0])
        if s < LITERALS:
            red, blue, alpha = (_symbol(r, t) for t in g[1:4])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
            lay.literals += main
        elif s < LITERALS + LENGTHS:
            length = unprefix(s - LITERALS, r)
            d = undistance(unprefix(_symbol(r, g[4]), r), width)
            if d > i or i + length > n:
                raise ValueError("a copy reaches outside the image")
            new = []
            for k in range(length):
                new.append(out[i - d + k] if k < d else new[k - d])
            lay.copies += main
        else:
            new = [cache.get(s - LITERALS - LENGTHS, 0)]
            lay.cached += main
        out += new
        if cache_bits:
            for v in new:
                cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = v
    if main:
        lay.data_bits = r.at - start
    return out


def decode(data: bytes) -> tuple[int, int, list[int], Layout]:
    """(width, height, packed pixels, layout) of a VP8L stream."""
    r, lay = Reader(data), Layout()
    if r.get(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height, lay.alpha = r.get(14) + 1, r.get(14) + 1, bool(r.get(1))
    if r.get(3):
        raise ValueError("unknown version")
    lay.width, lay.height, undo, w = width, height, [], width
    while r.get(1):
        kind = r.get(2)
        if kind in lay.transforms:
            raise ValueError("a transform comes twice")
        lay.transforms.append(kind)
        if kind in (PREDICTOR, COLOUR):
            size = r.get(3) + 2
            bw = (w + (1 << size) - 1) >> size
            undo.append((kind, w, size, bw, _get_image(r, bw, (height + (1 << size) - 1) >> size, lay, False)))
        elif kind == GREEN:
            undo.append((kind, w, 0, 0, None))
        else:
            n = r.get(8) + 1
            table = _get_image(r, n, 1, lay, False)
            for i in range(1, n):
                table[i] = _add(table[i], table[i - 1])
            k = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, w, k, 0, table))
            w = (w + (1 << k) - 1) >> k
    lay.header_bits = r.at
    p = _get_image(r, w, height, lay, True)
    lay.total_bits = r.at
    for kind, w, size, bw, extra in reversed(undo):
        if kind == GREEN:
            p = [v & 0xFF00FF00 | ((v >> 16) + (v >> 8) & 255) << 16 | (v + (v >> 8) & 255) for v in p]
        elif kind == PREDICTOR:
            out: list[int] = []
            for i, v in enumerate(p):
                out.append(0)
                out[i] = _add(v, predicted(out, i, w, extra[(i // w >> size) * bw + (i % w >> size)] >> 8 & 15))
            p = out
        elif kind == COLOUR:
            for i, v in enumerate(p):
                e = extra[(i // w >> size) * bw + (i % w >> size)]
                g = _signed(v >> 8 & 255)
                red = (v >> 16) + (_signed(e & 255) * g >> 5) & 255
                blue = v + (_signed(e >> 8 & 255) * g >> 5) + (_signed(e >> 16 & 255) * _signed(red) >> 5) & 255
                p[i] = v & 0xFF00FF00 | red << 16 | blue
        else:
            rows, pw, bits = [], (w + (1 << size) - 1) >> size, 8 >> size
            for y in range(height):
                for x in range(w):
                    i = (p[y * pw + (x >> size)] >> 8) >> ((x & (1 << size) - 1) * bits) & (1 << bits) - 1
                    rows.append(extra[i] if i < len(extra) else 0)
            p = rows
    return width, height, p, lay


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def container(stream: bytes, icc: bytes | None = None, exif: bytes | None = None, xmp: bytes | None = None) -> bytes:
    """RIFF file of a stream; extended only when there is metadata."""
    body = _chunk(b"VP8L", stream)
    if icc or exif or xmp:
        head = int.from_bytes(stream[1:5], "little")
        flags = (0x20 if icc else 0) | (0x10 if head >> 28 & 1 else 0) | (0x08 if exif else 0) | (0x04 if xmp else 0)
        size = (head & 0x3FFF).to_bytes(3, "little") + (head >> 14 & 0x3FFF).to_bytes(3, "little")
        body = _chunk(b"VP8X", bytes([flags, 0, 0, 0]) + size) + (_chunk(b"ICCP", icc) if icc else b"") + body + (_chunk(b"EXIF", exif) if exif else b"") + (_chunk(b"XMP ", xmp) if xmp else b"")
    if len(body) + 4 > 2**32 - 10:
        raise ValueError("too large for a RIFF file")
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def chunks(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of a RIFF file's chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at, end = [], 12, 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ValueError("the file ends early")
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            raise ValueError("a chunk goes beyond the file")
        out.append((data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + n]))
        at += 8 + n + (n & 1)
    return out


def lossy_layout(frame: bytes) -> dict[str, int]:
    """Sizes in a lossy frame's header: frame tag, first partition, other partitions."""
    if len(frame) < 10 or frame[3:6] != b"\x9d\x01\x2a":
        raise ValueError("not a lossy key frame")
    tag = int.from_bytes(frame[:3], "little")
    first = tag >> 5
    if tag & 1 or 10 + first > len(frame):
        raise ValueError("not a whole key frame")
    return {"width": int.from_bytes(frame[6:8], "little") & 0x3FFF, "height": int.from_bytes(frame[8:10], "little") & 0x3FFF, "first_partition": first, "other_partitions": len(frame) - 10 - first}
