"""Groups of tiles, colour elements, and what they cost."""

import numpy as np
from pyspark.sql import functions as F

from pixelloom.operators import tiles
from pixelloom.sources.fixtures import image, pixels


def test_features_by_brute_force(spark):
    px = image(spark, "alpha128").where("x < 32 AND y < 32").withColumn("width", F.lit(32))
    got = {r.tile: r.f for r in tiles.features(px, 4).collect()}
    rows = px.collect()
    for tile in range(4):
        mine = [r for r in rows if (r.y >> 4) * 2 + (r.x >> 4) == tile]
        want = []
        for c in sorted("rgba"):
            n = np.unique([r[c] for r in mine], return_counts=True)
            p = n[1] / len(mine)
            want += [float(-(p * np.log2(p)).sum()), sum(r[c] == 0 for r in mine) / len(mine), float(p.max())]
        assert np.allclose(got[tile], want)


def test_groups_settle_and_do_not_cost_more_than_one(spark):
    rng = np.random.default_rng(1)
    f = np.vstack([rng.normal(m, 0.1, (30, 3)) for m in (0, 5, 9)])
    g = tiles.k_means(f, 3)
    assert len(set(g)) == 3 and all(len(set(g[i : i + 30])) == 1 for i in (0, 30, 60))
    assert tiles.k_means(f[:1], 4).tolist() == [0] and len(set(tiles.k_means(np.zeros((5, 2)), 3))) == 1
    px = pixels(spark, ["alpha128"])
    one = tiles.group_cost(px, 5, tiles.clustered(tiles.features(px, 5), 1)).first()
    best = tiles.entropy_plan(px, [5, 6], [1, 4]).first()
    assert one.groups == 1 and best.cost <= one.cost


def test_colour_elements_save_bits(spark):
    px = image(spark, "photo512").where("x < 64 AND y < 64").withColumn("width", F.lit(64))
    found = tiles.colour_elements(px, 5).collect()
    assert len(found) == 4 and all(r.saved >= 0 for r in found) and any(r.saved > 0 for r in found)
    r, g = np.arange(200) % 256, (np.arange(200) * 7) % 256
    target = (r + (24 * ((g + 128) % 256 - 128) >> 5)) % 256
    start, at = tiles.colour_bits(target % 256, g, 0), tiles.descended(lambda e: tiles.colour_bits(target % 256, g, e))
    assert tiles.colour_bits(target % 256, g, at) <= start


def test_limited_planes(spark):
    r = tiles.near_lossless_planes(image(spark, "flat128")).first()
    assert 16 <= r.y <= 235 and 16 <= r.cb <= 240 and 16 <= r.cr <= 240
