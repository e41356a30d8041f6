"""How many lists are probed, and that every query gets its k."""

import numpy as np
import pytest

from campovia.llm import ann_adaptive

KIND = "vec_id long, embedding array<double>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], KIND)


def answers(df, **more):
    got: dict[int, list[tuple[int, float]]] = {}
    for r in ann_adaptive.nearest(df, df.where("vec_id % 20 = 0"), k=20, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def recall(got, x):
    asked = range(0, len(x), 20)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    kth = np.sort(score, axis=1)[:, -20]
    assert set(got) == set(asked) and all(len(got[q]) == 20 and len({i for i, _ in got[q]}) == 20 for q in asked)
    assert all(abs(score[q, i] - s) < 1e-9 for q in asked for i, s in got[q])
    return np.mean([s >= kth[q] - 1e-12 for q in asked for _, s in got[q]])


@pytest.mark.parametrize("rows", [900, 5000])
def test_recall_of_uniform_vectors_at_two_sizes(spark, rows):
    x = np.random.default_rng(rows).standard_normal((rows, 32))
    assert recall(answers(frame(spark, x)), x) >= 0.93


def test_vectors_in_clusters_need_few_lists(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 24))[rng.integers(0, 40, 4000)] * 10 + rng.standard_normal((4000, 24))
    assert recall(answers(frame(spark, x)), x) >= 0.95
    fit = ann_adaptive.lifted(x, (x * x).sum(1).max())
    centres = ann_adaptive.centroids(fit, 200, 1)
    q = ann_adaptive.lifted(x[:500], None)
    c = ann_adaptive.squared(q, centres)
    probed = (c <= c.min(axis=1)[:, None] + ann_adaptive.reach(q, np.arange(500), fit, centres, 20, 0.97)).mean()
    assert probed < 0.2


@pytest.mark.parametrize("seed", range(3))
def test_few_distinct_vectors_answer_every_query(spark, seed):
    """Coincident centres are one, lists without vectors are not probed: each query gets 20 rows, ties to the smaller ids."""
    rng = np.random.default_rng(seed)
    kinds = rng.standard_normal((4, 8))
    which = rng.choice(4, 2744, p=[0.001, 0.002, 0.3, 0.697])
    got = answers(frame(spark, kinds[which]))
    assert set(got) == set(range(0, 2744, 20)) and all(len(g) == 20 for g in got.values())
    for q, g in got.items():
        same_kind: dict[float, list[int]] = {}
        for i, s in g:
            same_kind.setdefault(which[i], []).append(i)
        for kind, found in same_kind.items():  # of each kind the smallest ids
            assert found == [i for i in np.flatnonzero(which == kind).tolist() if i != q][: len(found)]


def test_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    long, short = rng.standard_normal((60, 6)), rng.standard_normal((5, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(long)] + [(100 + 20 * i, v.tolist()) for i, v in enumerate(short)] + [(40, v.tolist()) for v in long[:30]]
    got = {}
    df = spark.createDataFrame(rows, KIND)
    for r in ann_adaptive.nearest(df, df.where("vec_id IN (0, 20, 100, 120)"), k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == [0, 20, 100, 120] and len(got[0]) == len(got[20]) == 20
    assert sorted(got[100]) == [120, 140, 160, 180]  # all the others of its length
    alone = spark.createDataFrame([(20, [1.0, 2.0])] * 50, KIND)
    assert ann_adaptive.nearest(alone, alone).count() == 0  # a query's own rows only
