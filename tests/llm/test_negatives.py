import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import hard_negatives as H

SCHEMA = "vec_id long, label long, vector array<double>, block string, place string, n string, asks string, rank int"


def sound(row):
    i, label, v = row[:3]
    return i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return max(H.LONG[0], min(H.LONG[1], sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def brute(rows, every, positives=5, negatives=5, percent=(80, 100)):
    rows = [r for r in rows if sound(r)]
    out = []
    for a in rows:
        if a[0] % every:
            continue
        others = [(dot(a[2], r[2]), r[0], r[1]) for r in rows if len(r[2]) == len(a[2])]
        near = sorted(((s, i) for s, i, label in others if label == a[1] and i != a[0]), key=lambda x: (-x[0], x[1]))[:positives]
        for ps, p in near:
            fits = [(s, i) for s, i, label in others if label != a[1] and percent[0] * ps <= 100 * s <= percent[1] * ps]
            out += [(a[0], p, rank, i, ps, s) for rank, (s, i) in enumerate(sorted(fits, key=lambda x: (-x[0], x[1]))[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    table = spark.createDataFrame([(*r, "clash", "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3)
    out = H.hard_negatives(table, F.col("vec_id") % every == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(seed=1, n=600, d=8, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 40, (labels, d))
    label = rng.choice(labels, n, p=[0.55, 0.25, 0.15, 0.05])
    # Some rows have the look of another label: these are the hard negatives.
    look = np.where(rng.random(n) < 0.2, rng.integers(0, labels, n), label)
    return [(i, int(a), [float(x) for x in v]) for i, (a, v) in enumerate(zip(label, np.floor(centres[look] + rng.normal(0, 12, (n, d)))))]


@pytest.mark.parametrize(("bits", "dims"), [(1, 3), (2, 2), (4, 2), (2, 4), (3, 3), (5, 1)])
def test_curve_visits_every_cell_by_steps_of_one(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = H.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    for scale in (1, 100, 1e9, 1e200):
        block = np.floor(rng.normal(0, 10, (30, 6)) * scale)
        asked = np.floor(rng.normal(0, 10, (9, 6)) * scale)
        least, greatest = H.bounds(asked, block.min(0)[None], block.max(0)[None])
        exact = H.products(asked, block)
        assert (exact.min(1) >= least[:, 0]).all() and (exact.max(1) <= greatest[:, 0]).all()


def test_windows():
    for percent in ((80, 100), (50, 75), (0, 100)):
        for score in range(-30, 31):
            low, high = H.window(score, percent)
            assert [s for s in range(-80, 81) if percent[0] * score <= 100 * s <= percent[1] * score] == list(range(low, high + 1))


@pytest.mark.parametrize(("block", "anchors", "maps", "part", "held"), [(16, 5, 3, 100, 40), (256, 256, 512, 1 << 15, 1 << 18)])
def test_negatives_against_brute_force(spark, monkeypatch, block, anchors, maps, part, held):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("MAPS", maps), ("PART", part), ("HELD", held)):
        monkeypatch.setattr(H, name, value)
    rows = clustered()
    # One vector very often, ties, repeated rows, nulls, other lengths, empty vectors, an anchor without company.
    rows += [(1000 + i, 1, rows[0][2]) for i in range(80)] + [(1100 + i, 0, rows[20][2]) for i in range(40)] + [rows[10], rows[10], rows[31], rows[7]]
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2001, 1, None), (2010, 1, [1.0, None] * 4), (2020, 1, [math.nan] * 8), (2030, 1, [math.inf] * 8)]
    rows += [(3000 + i, i % 2, [float(i), 3.0]) for i in range(20)] + [(3100, 0, []), (3101, 0, []), (3102, 1, []), (4000, 99, rows[0][2]), (5000, 0, [0.0] * 8)]
    want = brute(rows, 10)
    assert len(want) > 500
    assert found(spark, rows, 10) == want


def test_other_sizes_and_windows(spark):
    rows = clustered(2, 200)
    assert found(spark, rows, 7, positives=2, negatives=3, percent=(50, 90)) == brute(rows, 7, 2, 3, (50, 90))


def test_huge_values_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in np.floor(rng.normal(0, 1, 3) * 10.0 ** rng.integers(0, 14))]) for i in range(60)]
    rows += [(100 + i, i % 2, [1e300, -1e300 * (i % 3), 5.0]) for i in range(6)]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_empty_tables(spark):
    assert found(spark, [], 10) == [] and found(spark, [(None, None, None)], 10) == []
    assert found(spark, [(11, 1, [1.0]), (12, 1, [2.0])], 10) == []


def test_bounds_leave_most_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 60, (40, 6))
    rows = [(i, int(i % 8), [float(x) for x in np.floor(centres[i % 40] + rng.normal(0, 4, 6))]) for i in range(1600)]
    table = spark.createDataFrame(rows, "vec_id long, label long, vector array<double>").withColumn("asks", F.col("vec_id") % 20 == 0)
    blocks = H.candidate_blocks(table)
    anchors, maps = H._anchors(blocks, 5), H._zone_maps(blocks)
    pairs = H._needs(anchors.select("*", F.lit(b"").alias("wins")), maps, True).agg(F.sum("n")).first()[0]
    # Of the blocks of an anchor's own label, those that its floor cannot rule out.
    own = 80 * blocks.count() / 8
    assert pairs < 0.5 * own
