"""The lossless codec: what is written reads back, sizes are as planned, damage is noticed."""

import random

import pytest
from pyspark.sql import functions as F

from pixelloom.functions import vp8l
from pixelloom.operators import images
from pixelloom.sources.fixtures import hidden_rgb, image


def pictures():
    rng = random.Random(1)
    yield "noise", [rng.getrandbits(32) for _ in range(11 * 7)], 11, 7
    yield "flat", [0xFF102030] * 64, 8, 8
    yield "one", [0x80010203], 1, 1
    yield "two", [rng.choice([0xFF000000, 0xFFFFFFFF]) for _ in range(19 * 5)], 19, 5
    yield "sixteen", [0xFF000000 | rng.randrange(16) * 0x111111 for _ in range(33 * 9)], 33, 9
    yield "ramp", [0xFF000000 | (3 * x + y) % 256 << 16 | (x + 5 * y) % 256 << 8 | (7 * x) % 256 for y in range(24) for x in range(40)], 40, 24
    yield "tiles", [0xFF000000 | (x % 9 * 37 + y % 6 * 11) * 0x010203 & 0xFFFFFF for y in range(30) for x in range(45)], 45, 30
    yield "hidden", [(0 if (x + y) % 3 else 255) << 24 | x * 4000 + y * 77 for y in range(16) for x in range(16)], 16, 16


@pytest.mark.parametrize("mode", images.MODES)
@pytest.mark.parametrize("name,p,w,h", list(pictures()))
def test_round_trip(name, p, w, h, mode):
    data = vp8l.encode(p, w, h, mode)
    got = vp8l.decode(data)
    assert got[:3] == (w, h, p)
    assert got[3].total_bits <= 8 * len(data) < got[3].total_bits + 8


@pytest.mark.parametrize("chain", [("green",), *[(("predict", m),) for m in range(14)], ("green", ("predict", 5))])
def test_every_transform(chain):
    for _, p, w, h in pictures():
        assert vp8l.decode(vp8l._payload(p, w, h, chain, 4, True).done())[2] == p
        assert vp8l._payload(p, w, h, chain, 4, True).count == vp8l._payload(p, w, h, chain, 4, False).count


def test_best_is_never_larger():
    for _, p, w, h in pictures():
        assert len(vp8l.encode(p, w, h, "best")) <= len(vp8l.encode(p, w, h, "default")) + 1


def test_near_distances():
    assert len(vp8l.NEAR) == 120 and vp8l.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and vp8l.NEAR[-1] == (8, 7)
    for w in (1, 5, 16, 300):
        for d in range(1, 700):
            assert vp8l.undistance(vp8l.distance_code(d, w), w) == d


def test_prefix_codes():
    for v in range(1, 3000):
        s, n, e = vp8l.prefix(v)
        b = vp8l.Bits()
        b.put(e, n)
        assert vp8l.unprefix(s, vp8l.Reader(b.done() + b"\0\0\0")) == v


def test_container():
    stream = vp8l.encode([0x80FF0000] * 9, 3, 3)
    assert [n for n, _ in vp8l.chunks(vp8l.container(stream))] == ["VP8L"]
    full = vp8l.container(stream, icc=b"abc", exif=b"de", xmp=b"f")
    assert vp8l.container(stream, icc=b"", exif=None) == vp8l.container(stream)
    assert [n for n, _ in vp8l.chunks(full)] == ["VP8X", "ICCP", "VP8L", "EXIF", "XMP "] and dict(vp8l.chunks(full))["ICCP"] == b"abc"
    assert dict(vp8l.chunks(full))["VP8X"][0] == 0x20 | 0x10 | 0x08 | 0x04
    for bad in (b"", full[:30], b"RIFX" + full[4:]):
        with pytest.raises(ValueError):
            vp8l.chunks(bad)
    with pytest.raises(ValueError):
        vp8l.decode(stream[:-2])
    with pytest.raises(ValueError):
        vp8l.encode([], 0, 0)


def test_lossy_layout():
    frame = (40 << 5 | 1 << 4).to_bytes(3, "little") + b"\x9d\x01\x2a" + (17).to_bytes(2, "little") + (9).to_bytes(2, "little") + bytes(60)
    assert vp8l.lossy_layout(frame) == {"width": 17, "height": 9, "first_partition": 40, "other_partitions": 20}
    with pytest.raises(ValueError):
        vp8l.lossy_layout(frame[:20])


def test_images_as_rows(spark):
    px = hidden_rgb(spark).unionByName(image(spark, "alpha128").where("x < 24 AND y < 20").withColumns({"width": F.lit(24), "height": F.lit(20), "pos": F.expr("y * 24 + x")}))
    whole = images.packed(px).withColumn("xmp", F.lit(b"note"))
    files = images.encode(whole, "default").cache()
    back = images.decode(files)
    cols = ["img", "pos", "r", "g", "b", "a"]
    assert back.select(cols).exceptAll(px.select(cols)).count() == 0 == px.select(cols).exceptAll(back.select(cols)).count()
    lay = {r.img: r for r in images.layout(files).collect()}
    assert lay["hidden16"].alpha and all(r.header_bits + r.data_bits < r.total_bits <= 8 * r.bytes for r in lay.values())
    scored = images.candidates(images.packed(hidden_rgb(spark)), "default")
    assert images.best_candidate(scored).first().bits == min(r.bits for r in scored.collect())
    assert images.timed(images.packed(hidden_rgb(spark)), "fast", 2).count() == 2
