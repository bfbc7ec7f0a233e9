"""Hashed byte n-grams as array indexes."""

from __future__ import annotations

import numpy as np

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Fixed odd multiplier.
SPREAD = np.uint32(0x9E3779B1)


def grams(text: str, lower: bool) -> np.ndarray:
    """Bucket of every byte 3-gram of a text set between two spaces; a text of one byte or more has as many 3-grams as bytes."""
    raw = f" {text.lower() if lower else text} ".encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    g = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (g * SPREAD) >> np.uint32(32 - BUCKET_BITS)
