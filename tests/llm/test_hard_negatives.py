"""Hard-negative mining against plain loops."""

import math
import random

import numpy as np
import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from campovia.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, key int"


def brute(table, scale, positives, negatives, is_anchor):
    good = [(i, [math.floor(scale * c) for c in v], y) for i, v, y in table if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out, told = [], set()
    for a, v, y in good:
        if not is_anchor(a) or (a, tuple(v), y) in told:
            continue
        told.add((a, tuple(v), y))
        others = [(-dot(v, w), i, z) for i, w, z in good if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(o for o in others if o[2] == y)[:positives]:
            band = sorted(o for o in others if o[2] != y and 30 * -ps <= 100 * -o[0] <= 90 * -ps)[:negatives]
            out += [(a, p, n, o[1], -ps, -o[0]) for n, o in enumerate(band, 1)]
    return sorted(out)


def run(spark, table, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more).collect())


def cloud(n, dims, labels, seed):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, 1) for _ in range(dims)], draw.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole(spark, monkeypatch, seed):
    for name, value in (("BLOCK_ROWS", 60), ("GROUP_ANCHORS", 7), ("TILE_ROWS", 16), ("TILE_ANCHORS", 4), ("SAMPLE_ROWS", 50)):
        monkeypatch.setattr(hard_negatives, name, value)
    table = cloud(300, 6, 3, seed)
    table = [(i, table[7][1] if 100 <= i < 200 else v, y) for i, v, y in table]  # a third are copies of one vector: ties
    table += [(20, table[20][1], table[20][2]), (30, table[31][1], table[30][2]), (40, table[40][1], 9), (55, table[56][1], table[55][2])]  # repeated rows and ids
    table += [(400, None, 1), (410, [1.0] * 6, None), (420, [float("nan")] * 6, 1), (430, [float("inf")] * 6, 1), (440, [None] * 6, 1), (None, [1.0] * 6, 1), (450, [], 1)]
    table += [(500 + i, [float(i)] * (i % 20 + 1), i % 2) for i in range(60)]  # twenty lengths
    assert run(spark, table, positives=3, negatives=4) == brute(table, 256, 3, 4, lambda i: i % 10 == 0)


def test_edges(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1)]) == [] and run(spark, [(10, [1.0], 1)]) == []
    same = [(i, [0.0, 0.0], i % 2) for i in range(30)]  # all scores are 0: every band holds 0
    assert run(spark, same) == brute(same, 256, 5, 10, lambda i: i % 10 == 0) and len(run(spark, same)) == 3 * 5 * 10
    away = [(10, [1.0], 1), (11, [-1.0], 1), (12, [-0.5], 2)]  # a negative positive score leaves no band
    assert run(spark, away) == []
    with pytest.raises(OverflowError):
        run(spark, [(10, [1e9], 1), (11, [1e9], 2)])


def test_brackets_hold_and_spare_work():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (12, 8))
    x = np.floor(centres[rng.integers(0, 12, 6000)] + rng.normal(0, 20, (6000, 8)))
    top = float((x * x).sum(axis=1).max())
    pivots = hard_negatives.farthest_first(hard_negatives.augmented(x[:500], top), 16)
    d, a = hard_negatives.to_pivots(hard_negatives.augmented(x, top), pivots), hard_negatives.to_pivots(hard_negatives.augmented(x[:50], None), pivots)
    least, most = hard_negatives.brackets((x[:50] ** 2).sum(axis=1), a, d, d, top)
    assert (least <= x[:50] @ x.T).all() and (x[:50] @ x.T <= most).all()
    side = lambda n, dist: hard_negatives.Side(np.arange(n), np.zeros(n, int), x[:n], dist, np.arange(n))
    endless = np.full((50, 1), np.inf)
    found, checked = hard_negatives.best_in_bands(side(50, a), -endless, endless, side(6000, d), True, top, 5)
    assert len(found[0]) == 250 and checked < 0.3 * 50 * 6000
    scores = x[:50] @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    assert (found[3].reshape(50, 5) == -np.sort(-scores, axis=1)[:, :5]).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    ours, theirs = queries.op12_hard_negatives(spark, folder).toPandas(), connect(folder).execute(hard_negatives.ORACLE_SQL).fetchdf()
    assert len(ours) and rows(ours) == rows(theirs)
