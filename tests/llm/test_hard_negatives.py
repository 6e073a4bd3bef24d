"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultmill.llm import hardnegatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score int, note string"


def brute(rows):
    """(anchor, positive, rank, negative, scores) by plain sorting of all rows."""
    good = [(i, str(lab), [math.floor(256 * x) for x in e]) for i, lab, e in rows
            if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    made = []
    for k, (a, lab, u) in enumerate(good):
        if a is None or a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(u, v, strict=True)), math.inf if b is None else b, b, m)
                  for j, (b, m, v) in enumerate(good) if j != k and len(v) == len(u)]
        scored.sort(key=lambda s: s[:2])
        for p in [s for s in scored if s[3] == lab][:5]:
            held = [s for s in scored if s[3] != lab and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            made += [(a, p[2], r, s[2], -p[0], -s[0]) for r, s in enumerate(held, 1)]
    return made


def mined(frame):
    return [tuple(r) for r in hn.mine(frame, F.col("vec_id") % 100 == 0).collect()]


def key(row):
    return [(x is None, x or 0) for x in row]


@pytest.mark.parametrize(("block", "at_once"), [(512, 8192), (7, 3)])
def test_against_brute_force(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", at_once)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(4, 6))
    rows = [(i, int(i % 4), (centres[(i // 3) % 4] + draw.normal(size=6) * 0.4).round(1).tolist()) for i in range(350)]
    rows += [(1000, 0, rows[5][2]), (1000, 0, rows[5][2]), (5, 1, rows[5][2]), (None, 2, rows[6][2]), (None, 0, rows[6][2])]
    rows += [(1100, None, rows[5][2]), (1200, 1, None), (1300, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1400, 1, [math.inf] * 6),
             (1500, 1, [math.nan] * 6), (1600, 3, []), (1601, 2, []), (1602, 3, []), (1700, 9, [0.5] * 6), (1800, 2, [0.1, 0.2]),
             (1801, 2, [0.1, 0.2]), (1802, 1, [0.1, 0.1]), (1900, 2, [0.0] * 6)]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)
    exact = [(i, lab, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, lab, e in rows]
    want = brute(exact)
    assert len(want) > 200 and 1000 in {w[0] for w in want}
    assert sorted(mined(frame), key=key) == sorted(want, key=key)


def test_large_components(spark):
    rows = [(0, 1, [1000.0, -900.0]), (1, 1, [990.0, -910.0]), (2, 0, [400.0, -500.0]), (3, 0, [1e30, 0.0]), (4, 0, [700.0, -700.0])]
    frame = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)
    assert sorted(mined(frame)) == sorted(brute([r for r in rows if r[0] != 3]))


def test_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert mined(frame) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0], 1, "a"), (None, None, None, None, None)], SCHEMA)) == []


def test_hilbert_is_one_path_through_the_grid():
    side = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = sorted(range(64), key=lambda i: hn.hilbert(side, 2)[i].tobytes())
    assert np.abs(np.diff(side[order], axis=0)).sum(axis=1).tolist() == [1] * 63


def test_bounds_hold():
    draw = np.random.default_rng(1)
    points, anchors = draw.integers(-300, 300, (50, 8)), draw.integers(-300, 300, (20, 8))
    low, high = hn.bounds(anchors, points.min(axis=0), points.max(axis=0))
    scores = hn.products(anchors, points)
    assert (scores >= low[:, None]).all() and (scores <= high[:, None]).all()
    huge = np.array([[1 << 26, 3]])
    assert hn.products(huge, huge).tolist() == [[(1 << 52) + 9]]


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """Well separated groups: windows of one group meet few blocks of the others."""
    monkeypatch.setattr(hn, "BLOCK", 16)
    draw = np.random.default_rng(2)
    rows = [(i, int(i % 8 == 0), (np.eye(8)[i // 8 % 8] + draw.normal(size=8) * 0.02).tolist(), 1, "") for i in range(2000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    read = []
    original = hn._chosen
    monkeypatch.setattr(hn, "_chosen", lambda b, a, w: read.append((b.count(), original(b, a, w))) or read[-1][1])
    assert sorted(mined(frame)) == sorted(brute([(i, lab, [float(np.float32(x)) for x in e]) for i, lab, e, _, _ in rows]))
    total, chosen = read[0]
    bits = sum(sum(bin(x).count("1") for x in r.wanted) for r in chosen.collect())
    assert 0 < bits < 0.5 * total * 100
