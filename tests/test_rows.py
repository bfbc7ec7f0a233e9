"""Row by row gives back the image, with two rows in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.sources.fixtures import pixels
from pixelloom.streaming import rows


def rebuilt(tokens, width, height):
    p = np.zeros(width * height, np.int64)
    for t in tokens:
        at = t.y * width + t.x
        if t.distance == 0:
            p[at] = t.pixel
        else:
            for k in range(t.length):
                p[at + k] = p[at + k - t.distance]
    return p


@pytest.mark.parametrize("literal", [True, False])
def test_tokens_give_the_rows_back(spark, literal):
    r = rows.rows(pixels(spark, ["flat128", "alpha128"])).cache()
    want = {}
    for x in r.orderBy("y").collect():
        want.setdefault(x.img, []).extend(x.argb)
    found = rows.tokens(r, literal).orderBy("y", "x").collect()
    for img, p in want.items():
        mine = [t for t in found if t.img == img]
        assert rebuilt(mine, 128, 128).tolist() == p
        assert sum(t.length for t in mine) == 128 * 128
    assert literal or sum(t.img == "flat128" for t in found) < 400


def test_plan_takes_the_fewest_bits(spark):
    r = rows.rows(pixels(spark, ["gradient128", "alpha128"]))
    chosen = {x.img: (x.transform, x.bits) for x in rows.plan(r, 128).collect()}
    bits = {k: {x.img: x.bits for x in rows.token_bits(rows.tokens(d), 128).collect()} for k, d in (("direct", r), ("green", rows.without_green(r)))}
    for img, (name, n) in chosen.items():
        assert n == bits[name][img] == min(b[img] for b in bits.values())
    green = rows.without_green(r).where("img = 'gradient128' AND y = 3").select(F.element_at("argb", 6).alias("p")).first().p
    assert green == 0xFF000000 | (18 - 20) % 256 << 16 | 20 << 8 | (68 - 20) % 256
