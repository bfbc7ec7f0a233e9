"""4 x 4 block transforms, once for columns and for arrays: a block is a list of 16 values by rows, whatever they are.

The forward cosine transform is a product with an orthogonal matrix, rounded to the nearest integer, halves up. The inverse is what
the bitstream format fixes, to the bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

#: The cosine basis; its product on both sides of a block is twice the coefficients.
COSINE = [[1.0, 1.0, 1.0, 1.0], [math.sqrt(2) * math.cos(math.pi / 8), math.sqrt(2) * math.sin(math.pi / 8), -math.sqrt(2) * math.sin(math.pi / 8), -math.sqrt(2) * math.cos(math.pi / 8)], [1.0, -1.0, -1.0, 1.0], [math.sqrt(2) * math.sin(math.pi / 8), -math.sqrt(2) * math.cos(math.pi / 8), math.sqrt(2) * math.cos(math.pi / 8), -math.sqrt(2) * math.sin(math.pi / 8)]]
#: A Hadamard matrix in order of rising frequency; it is its own transpose.
HADAMARD = [[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]]
# Fixed values of the bitstream format: the cosine and sine factors in 16 fractional bits, and the rounding of both inverses.
COS_16, SIN_16, DCT_HALF, WHT_HALF = 85627, 35468, 4, 3


def times(matrix: list[list], v: list) -> list:
    """A matrix times a vector of columns or arrays."""
    return [sum((m * x for m, x in zip(row[1:], v[1:])), row[0] * v[0]) for row in matrix]


def both_ways(block: list, one: Callable[[list], list]) -> list:
    """A one-dimensional transform of every column of a block, then of every row."""
    down = [one(block[i::4]) for i in range(4)]
    across = [one([column[y] for column in down]) for y in range(4)]
    return [v for row in across for v in row]


def forward_dct(block: list, floor: Callable[[Any], Any]) -> list:
    return [floor(v * 0.5 + 0.5) for v in both_ways(block, lambda v: times(COSINE, v))]


def inverse_dct(block: list, shift: Callable[[Any, int], Any]) -> list:
    """Residuals of coefficients. shift: to the right, rounding down."""

    def one(c: list) -> list:
        even = [c[0] + c[2], c[0] - c[2]]
        odd = [shift(c[1] * COS_16, 16) + shift(c[3] * SIN_16, 16), shift(c[1] * SIN_16, 16) - shift(c[3] * COS_16, 16)]
        return [even[0] + odd[0], even[1] + odd[1], even[1] - odd[1], even[0] - odd[0]]

    return [shift(v + DCT_HALF, 3) for v in both_ways(block, one)]


def forward_wht(block: list, shift: Callable[[Any, int], Any]) -> list:
    return [shift(v, 1) for v in both_ways(block, lambda v: times(HADAMARD, v))]


def inverse_wht(block: list, shift: Callable[[Any, int], Any]) -> list:
    return [shift(v + WHT_HALF, 3) for v in both_ways(block, lambda v: times(HADAMARD, v))]
