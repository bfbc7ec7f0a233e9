"""Parts of lossy coding."""

import random

import numpy as np
import pytest

from pixelloom.functions import vp8
from pixelloom.operators import lossy
from pixelloom.sources.fixtures import image


@pytest.mark.parametrize("seed", range(6))
def test_range_coder(seed):
    rng = random.Random(seed)
    sent = [(int(rng.random() > p / 256) if rng.random() < 0.9 else rng.randint(0, 1), p) for p in (rng.choice([1, 3, 128, 200, 254, 255]) for _ in range(4000))]
    w = vp8.BoolWriter()
    for bit, p in sent:
        w.put(bit, p)
    w.number(1234, 11)
    r = vp8.BoolReader(w.done())
    assert [r.get(p) for _, p in sent] == [b for b, _ in sent] and r.number(11) == 1234


def test_range_coder_carries():
    w = vp8.BoolWriter()
    for _ in range(3000):
        w.put(1, 1)
    r = vp8.BoolReader(w.done())
    assert all(r.get(1) for _ in range(3000))


def test_transform():
    rng = np.random.default_rng(1)
    r = rng.integers(-255, 256, (200, 4, 4))
    assert np.abs(vp8.inverse_dct(vp8.forward_dct(r)) - r).max() <= 2


def test_flat_image_needs_nothing():
    y, c = np.full((32, 32), 128), np.full((16, 16), 128)
    found, rec = vp8.decide(y, c, c, 40, 40)
    assert all(x.nonzero == 0 and x.distortion == 0 for x in found) and (rec[0] == y).all()


def test_quality_follows_the_quantizer(spark):
    p = lossy.planes(image(spark, "alpha128"), 128, 128)
    got = {r.q: r for r in lossy.curve(lossy.modes(p, 128, 128, [4, 16, 64])).collect()}
    assert got[4].psnr > got[16].psnr > got[64].psnr > 15 and got[4].psnr > 40
    assert got[4].nonzero > got[16].nonzero > got[64].nonzero and got[4].blocks == 64
