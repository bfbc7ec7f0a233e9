"""Parts of lossy coding: the boolean range coder, block predictions, transforms on arrays, and macroblock mode decision.

Prediction reads reconstructed neighbours, so an image is decided in raster order; images are the unit of parallel work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pixelloom.functions import transforms

DC, TRUE_MOTION, VERTICAL, HORIZONTAL = range(4)
#: What stands above the first row and left of the first column.
ABOVE, LEFT = 127, 129


class BoolWriter:
    """Range coder of booleans; a carry runs back through the bytes already out."""

    def __init__(self):
        self.low, self.range, self.shift, self.out = 0, 255, 24, bytearray()

    def put(self, bit: int, probability: int) -> None:
        """probability / 256 is that of a 0."""
        split = 1 + ((self.range - 1) * probability >> 8)
        if bit:
            self.low += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            self._double()

    def _double(self) -> None:
        self.low <<= 1
        if self.low >> 32:
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
            self.low &= 0xFFFFFFFF
        self.shift -= 1
        if not self.shift:
            self.out.append(self.low >> 24)
            self.low &= 0xFFFFFF
            self.shift = 8

    def number(self, value: int, bits: int) -> None:
        for i in range(bits - 1, -1, -1):
            self.put(value >> i & 1, 128)

    def done(self) -> bytes:
        for _ in range(32):
            self._double()
        return bytes(self.out)


class BoolReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.range, self.left = data, 2, 255, 8
        self.value = int.from_bytes(data[:2].ljust(2, b"\0"), "big")

    def get(self, probability: int) -> int:
        split = 1 + ((self.range - 1) * probability >> 8)
        bit = self.value >= split << 8
        if bit:
            self.value -= split << 8
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            self.value <<= 1
            self.left -= 1
            if not self.left:
                self.value |= self.data[self.at] if self.at < len(self.data) else 0
                self.at += 1
                self.left = 8
        return int(bit)

    def number(self, bits: int) -> int:
        v = 0
        for _ in range(bits):
            v = v << 1 | self.get(128)
        return v


def forward_dct(r: np.ndarray) -> np.ndarray:
    """4 x 4 residuals (..., 4, 4) to coefficients."""
    return _stacked(transforms.forward_dct(_listed(r.astype(float)), np.floor), r).astype(np.int64)


def inverse_dct(c: np.ndarray) -> np.ndarray:
    """Coefficients to residuals."""
    return _stacked(transforms.inverse_dct(_listed(c), np.right_shift), c)


def _listed(b: np.ndarray) -> list[np.ndarray]:
    return [b[..., i // 4, i % 4] for i in range(16)]


def _stacked(v: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    return np.stack(v, -1).reshape(like.shape)


def quantized(c: np.ndarray, dc: int, ac: int, bias: int = 128) -> np.ndarray:
    q = np.full((4, 4), ac)
    q[0, 0] = dc
    return np.sign(c) * np.minimum((np.abs(c) * 256 + q * bias) // (q * 256), 2047)


def prediction(rec: np.ndarray, x: int, y: int, n: int, mode: int) -> np.ndarray:
    """n x n block at (x, y) from what stands above and left in the reconstruction."""
    above = rec[y - 1, x : x + n].astype(int) if y else np.full(n, ABOVE)
    left = rec[y : y + n, x - 1].astype(int) if x else np.full(n, LEFT)
    if mode == VERTICAL:
        return np.broadcast_to(above, (n, n))
    if mode == HORIZONTAL:
        return np.broadcast_to(left[:, None], (n, n))
    if mode == TRUE_MOTION:
        corner = int(rec[y - 1, x - 1]) if x and y else ABOVE if not y else LEFT
        return np.clip(left[:, None] + above[None, :] - corner, 0, 255)
    if x and y:
        v = (above.sum() + left.sum() + n) // (2 * n)
    elif x or y:
        v = ((left if x else above).sum() + n // 2) // n
    else:
        v = 128
    return np.full((n, n), v)


def _blocks(a: np.ndarray) -> np.ndarray:
    n = a.shape[0] // 4
    return a.reshape(n, 4, n, 4).swapaxes(1, 2)


def _whole(b: np.ndarray) -> np.ndarray:
    n = b.shape[0]
    return b.swapaxes(1, 2).reshape(4 * n, 4 * n)


def coded(target: np.ndarray, guess: np.ndarray, dc: int, ac: int) -> tuple[np.ndarray, np.ndarray]:
    """(reconstruction, levels) of a block's residual."""
    levels = quantized(forward_dct(_blocks(target.astype(int) - guess)), dc, ac)
    scale = np.full((4, 4), ac)
    scale[0, 0] = dc
    return np.clip(guess + _whole(inverse_dct(levels * scale)), 0, 255), levels


def rate(levels: np.ndarray) -> int:
    """Approximate cost in 1/256 bit: magnitudes, and a sign for each that is not zero."""
    m = np.abs(levels)
    return int((256 * (2 * np.floor(np.log2(m + 1)) + (m > 0))).sum()) + 64 * levels.shape[0] ** 2


@dataclass
class Choice:
    mbx: int
    mby: int
    mode: int
    chroma_mode: int
    nonzero: int
    distortion: int
    score: int


def decide(luma: np.ndarray, cb: np.ndarray, cr: np.ndarray, dc: int, ac: int) -> tuple[list[Choice], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Modes of every macroblock by distortion plus weighted rate, and the reconstructed planes. Sizes are multiples of 16 (chroma 8)."""
    weight = max(ac * ac // 8, 1)
    planes = [np.zeros_like(p) for p in (luma, cb, cr)]
    out = []
    for my in range(luma.shape[0] // 16):
        for mx in range(luma.shape[1] // 16):
            best = None
            t = luma[16 * my : 16 * my + 16, 16 * mx : 16 * mx + 16]
            for mode in range(4):
                rec, levels = coded(t, prediction(planes[0], 16 * mx, 16 * my, 16, mode), dc, ac)
                d = int(((rec - t.astype(int)) ** 2).sum())
                score = d + (rate(levels) * weight + 128) // 256
                if best is None or score < best[0]:
                    best = (score, mode, d, int((levels != 0).sum()), rec)
            planes[0][16 * my : 16 * my + 16, 16 * mx : 16 * mx + 16] = best[4]
            both = None
            for mode in range(4):
                got, total, dist, live = [], 0, 0, 0
                for p, source in ((1, cb), (2, cr)):
                    s = source[8 * my : 8 * my + 8, 8 * mx : 8 * mx + 8]
                    rec, levels = coded(s, prediction(planes[p], 8 * mx, 8 * my, 8, mode), dc, ac)
                    d = int(((rec - s.astype(int)) ** 2).sum())
                    got.append(rec)
                    dist += d
                    live += int((levels != 0).sum())
                    total += d + (rate(levels) * weight + 128) // 256
                if both is None or total < both[0]:
                    both = (total, mode, dist, live, got)
            for p in (1, 2):
                planes[p][8 * my : 8 * my + 8, 8 * mx : 8 * mx + 8] = both[4][p - 1]
            out.append(Choice(mx, my, best[1], both[1], best[3] + both[3], best[2] + both[2], best[0] + both[0]))
    return out, tuple(planes)
