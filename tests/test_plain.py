"""Queries that SQL cannot express, held against plain Python over their whole output."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from campovia.plans import catalogue
from campovia.plans.base import points, team

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b - d) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def table(spark):
    own = points(spark, FOLDER).toPandas()
    own.index = own.id.to_numpy()
    return own


@pytest.fixture(scope="module")
def staff(spark):
    return team(spark, FOLDER).toDF("cid", "clat", "clon").toPandas().sort_values("cid")


def result(spark, name) -> pd.DataFrame:
    return QUERIES[name](spark, FOLDER).toPandas()


def spread(xy, labels):
    return sum(((xy[labels == j] - xy[labels == j].mean(0)) ** 2).sum() for j in set(labels))


def partitions(n, k):
    """All ways to label n things with at most k labels."""
    return (np.array(x) for x in itertools.product(range(k), repeat=n) if all(x[i] <= max((-1, *x[:i])) + 1 for i in range(n)))


def test_kmeans_is_no_worse_than_all_ways(spark, table):
    got = result(spark, "cl04_cl05_kmeans").set_index("id").loc[table.id].reset_index()
    assert sorted(got.id) == sorted(table.id) and (got.state.to_numpy() == table.state.to_numpy()).all()
    seen = 0
    for _, own in got.groupby("state"):
        xy = table.loc[own.id, ["lat", "lon"]].to_numpy()
        assert own.label.nunique() == min(4, len(np.unique(xy, axis=0)))
        if len(own) <= 7:
            best = min(spread(xy, x) for x in partitions(len(own), 4))
            assert spread(xy, own.label.to_numpy()) <= 1.05 * best + 1e-9
            seen += 1
    assert seen > 5


@pytest.mark.parametrize("name,most", [("cl06_balanced_kmeans", 25), ("cl07_feature_kmeans", 25), ("cl18_theoretical_routes", None), ("cl08_dbscan", None)])
def test_labels_partition_the_points(spark, table, name, most):
    got = result(spark, name)
    assert sorted(got.id) == sorted(table.id) and (got.state.to_numpy() == table.state.loc[got.id].to_numpy()).all()
    for _, own in got.groupby("state"):
        assert set(own.label) == set(range(own.label.nunique()))
        assert most is None or own.groupby("label").size().max() <= most


def test_dbscan_by_hand(spark, table):
    """Core points, their connected parts, and everything else at the nearest part's mean."""
    got = result(spark, "cl08_dbscan").set_index("id")
    for _, own in table.groupby("state"):
        xy, ids = own[["lat", "lon"]].to_numpy(), own.id.to_numpy()
        near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) <= 60.0 / 111
        core = near.sum(1) >= 3
        part = {i: i for i in np.flatnonzero(core)}
        for _ in range(len(ids)):
            part = {i: min(part[j] for j in part if near[i, j]) for i in part}
        label = got.loc[ids, "label"].to_numpy()
        if not part:
            assert set(label) == {0}
        for i, j in itertools.combinations(part, 2):
            assert (part[i] == part[j]) == (label[i] == label[j])


def test_greedy_consultants_in_order(spark, table, staff):
    got = result(spark, "cl12_greedy_consultants").set_index("id")
    assert len(got) == len(table)
    for _, own in table.groupby("state"):
        left = {c: 3 for c in staff.cid}
        for p in own.sort_values("id").itertuples():
            d = {c.cid: km(p.lat, p.lon, c.clat, c.clon) for c in staff.itertuples()}
            free = [c for c in d if left[c] > 0]
            want = min(free or d, key=lambda c: (round(d[c], 9), c))
            row = got.loc[p.id]
            assert row.consultor == want and abs(row.distancia_km - d[want]) < 1e-6 and row.excedente == (not free)
            left[want] -= 1


def test_points_without_coordinates_have_no_consultant(spark):
    from campovia.operators import territory

    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 0.0), (2, 3, 1.0, None)], "g long, id long, lat double, lon double")
    staff = spark.createDataFrame([(7, 0.0, 0.5)], "id long, lat double, lon double")
    for greedy in (True, False):
        got = {r.id: (r.consultor, r.excedente) for r in territory.with_consultants(p, "g", "id", "lat", "lon", staff, None, 5, greedy=greedy).collect()}
        assert got == {1: (7, False), 2: (None, False), 3: (None, False)}


def test_banded_consultants_cost_least(spark, table, staff):
    """No swap of two points and no move to a consultant with room lowers the cost: with one band for all that is the optimum's mark, and small groups are tried out whole."""
    got = result(spark, "cl13_cl26_banded_consultants").set_index("id")
    tried = 0
    for _, own in table.groupby("state"):
        d = np.array([[round(1000 * km(p.lat, p.lon, c.clat, c.clon)) for c in staff.itertuples()] for p in own.itertuples()])
        at = [list(staff.cid).index(c) for c in got.loc[own.id, "consultor"]]
        load, n, k = Counter(at), len(own), len(staff)
        low, high = (1 if k <= n else 0), (4 if 4 * k >= n else n)
        assert all(low <= load[j] <= high for j in range(k))
        cost = sum(d[i, j] for i, j in enumerate(at))
        if k**n <= 200_000:
            best = min(sum(d[i, j] for i, j in enumerate(x)) for x in itertools.product(range(k), repeat=n) if all(low <= c <= high for c in np.bincount(x, minlength=k)))
            assert abs(cost - best) <= n
            tried += 1
        for a, b in itertools.combinations(range(n), 2):
            assert d[a, at[b]] + d[b, at[a]] >= d[a, at[a]] + d[b, at[b]] - 2
    assert tried


def test_bands_after_rebalancing(spark, table):
    got = result(spark, "cl15_rebalanced")
    assert sorted(got.id) == sorted(table.id)
    sizes = got.groupby(["state", "label"]).agg(n=("id", "size"), s=("banda_status", "unique"))
    assert (sizes.n <= 12).all() and all(list(s) == (["ABAIXO_MIN"] if n < 5 else ["OK"]) for n, s in zip(sizes.n, sizes.s))
    run = result(spark, "cl27_cluster_run")
    parts = run.groupby(["state", "label"]).size()
    assert run.id.is_unique and set(run.id) <= set(table.id) and parts.max() <= 15
    for _, own in run.groupby("state"):
        assert set(own.label) == set(range(own.label.nunique()))


@pytest.mark.parametrize("name,reach", [("cl22_balanced_centres", 300.0), ("cl24_balanced_points", None)])
def test_balanced_centres_keep_true_distances(spark, table, staff, name, reach):
    got = result(spark, name)
    where = staff.set_index("cid")
    assert sorted(got.id) == sorted(table.id)
    for r in got.itertuples():
        d = km(table.lat[r.id], table.lon[r.id], where.clat[r.cid], where.clon[r.cid])
        assert abs(d - r.distancia_km) < 1e-6 and abs(r.tempo_min - d / 40 * 60) < 1e-6


def tour_length(order, xy, start):
    stops = [start, *[xy[i] for i in order], start]
    return sum(km(*a, *b) for a, b in zip(stops, stops[1:]))


def routes(spark, table, name):
    got = result(spark, name)
    assert sorted(got.id) == sorted(table.id)
    means = table.groupby("state")[["lat", "lon"]].mean()
    xy = {i: (a, b) for i, a, b in zip(table.id, table.lat, table.lon)}
    for (state, _), own in got.groupby(["state", "route"]):
        own = own.sort_values("seq")
        assert own.seq.tolist() == list(range(1, len(own) + 1))
        yield state, own.id.tolist(), tuple(means.loc[state]), xy


def test_tours_take_the_nearest_next(spark, table):
    for _, order, start, xy in routes(spark, table, "rt01_tours"):
        at, left = start, sorted(order)
        for stop in order:
            nearest = min(km(*at, *xy[i]) for i in left)
            assert km(*at, *xy[stop]) <= nearest + 1e-6
            left.remove(stop)
            at = xy[stop]


def test_two_opt_leaves_no_gain(spark, table):
    plain = {(s, frozenset(o)): tour_length(o, xy, start) for s, o, start, xy in routes(spark, table, "rt01_tours")}
    for state, order, start, xy in routes(spark, table, "rt03_two_opt"):
        length = tour_length(order, xy, start)
        assert length <= plain[(state, frozenset(order))] + 1e-6
        for i, j in itertools.combinations(range(len(order) if len(order) > 3 else 0), 2):  # shorter ones stay as they are
            assert tour_length(order[:i] + order[i : j + 1][::-1] + order[j + 1 :], xy, start) >= length - 1e-6


@pytest.mark.parametrize("name", ["rt07_split_fixed", "rt08_split_adaptive", "rt09_split_iterative", "rt10_split_capacity", "rt11_split_balanced"])
def test_splits_partition_and_cost_their_tours(spark, table, name):
    got = result(spark, name)
    assert sorted(got.id) == sorted(table.id) and not got.status.str.startswith("erro").any()
    for (_, _), own in got.groupby(["state", "rota"]):
        own = own.sort_values("seq")
        assert own.seq.tolist() == list(range(1, len(own) + 1)) and (own.n_pdvs == len(own)).all()
        assert own.km.nunique() == own.minutes.nunique() == own.status.nunique() == 1
        legs = [table.loc[i, ["lat", "lon"]].tolist() for i in own.id]
        least = max((km(*a, *b) for a in legs for b in legs), default=0)
        assert own.km.iloc[0] >= 2 * least * 0.9  # a closed tour passes its farthest pair twice, from a start among the stops
        assert own.minutes.iloc[0] >= 30 * len(own) - 1


def test_balanced_groups_keep_to_their_contract():
    from campovia.operators import heuristics as h

    rng = np.random.default_rng(4)
    for n in (1, 5, 23, 60, 140):
        xy = rng.standard_normal((n, 2)) * [1, 2]
        for k in (1, 3, 6):
            groups = h.balanced_groups(xy, min(k, n), 4, 9)
            assert sorted(np.concatenate(groups).tolist()) == list(range(n))
            assert len(groups) == 1 or min(map(len, groups)) >= 4
            merged = h.merge_small(xy, [np.flatnonzero(np.arange(n) % 7 == j) for j in range(min(7, n))], 6, 25)
            assert sorted(np.concatenate(merged).tolist()) == list(range(n)) and max(map(len, merged)) <= max(25, -(-n // 7))


def moved_at_the_border(xy, labels, centres, most):
    """The rule in plain loops: of the largest cluster, for each cluster with room, the point nearest to its centre; of those, the smallest ratio of distances."""
    labels = [int(x) for x in labels]
    dist = lambda p, c: math.dist(xy[p], centres[c])
    for _ in labels:
        sizes = [labels.count(c) for c in range(len(centres))]
        full = sizes.index(max(sizes))
        if sizes[full] <= most:
            break
        options = []
        for c, size in enumerate(sizes):
            if size < most:
                p = min((p for p, own in enumerate(labels) if own == full), key=lambda p: (dist(p, c), p))  # noqa: B023
                options.append((dist(p, c) / max(dist(p, full), 1e-9), c, p))
        if not options or min(options)[0] > 2.0:
            break
        labels[min(options)[2]] = min(options)[1]
    return labels


def test_redistribution_moves_border_points():
    from campovia.operators import heuristics as h

    # the point least farther in proportion (0.9 | 0.85 away) is not the one nearest to the other centre (1.2 | 0.8)
    xy, centres = np.array([[0.0, 0], [0.3, 0.85], [1.2, 0.0], [2.0, 0.0]]), np.array([[0.0, 0], [2.0, 0]])
    assert h.redistribute(xy, np.array([0, 0, 0, 1]), centres, 2).tolist() == [0, 0, 1, 1]
    rng, differ = np.random.default_rng(6), 0
    for _ in range(200):
        n, k = int(rng.integers(5, 40)), int(rng.integers(2, 6))
        xy, labels = rng.standard_normal((n, 2)), rng.integers(0, k, n) * (rng.random(n) < 0.5)
        centres = np.array([xy[labels == c].mean(axis=0) if (labels == c).any() else rng.standard_normal(2) for c in range(k)])
        got = h.redistribute(xy, labels, centres, -(-n // k)).tolist()
        assert got == moved_at_the_border(xy, labels, centres, -(-n // k))
        differ += got != labels.tolist()
    assert differ > 100


def test_time_windows_of_the_query(spark, table):
    got = result(spark, "rt12_time_windows")
    assert sorted(got.id) == sorted(table.id)
    served = got[got.status == "viavel_sla"]
    for r in served.itertuples():
        assert 480 + r.id % 4 * 60 <= r.chegada + 1e-6 and r.chegada + 20 <= 900 + r.id % 3 * 60 + 1e-6
    for _, own in served.groupby(["state", "route", "rota"]):
        own = own.sort_values("seq")
        stops = [(table.lat[i], table.lon[i]) for i in own.id]
        for (a, b), (s, t) in zip(zip(stops, stops[1:]), zip(own.chegada, own.chegada[1:])):
            assert t >= s + 20 - 1e-6 and km(*a, *b) > -1


def test_running_numbers_pick_the_places(spark):
    from campovia.operators import reports

    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in range(30) for v in rng.integers(0, 9, rng.integers(1, 50))] + [(99, None), (7, None)]
    got = reports.ranked_values(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", m=reports.median_rank, p=reports.p95_rank, q=reports.nearest_p95_rank).collect()
    assert len(got) == 30
    for r in got:
        d = sorted(v for g, v in rows if g == r.g and v is not None)
        n = len(d)
        assert (r.m, r.p, r.q) == (d[n // 2], d[0] if n < 2 else d[int(0.95 * n) - 1], d[round(0.95 * (n - 1))])


def test_sources_with_repeated_keys_repeat_no_row(spark):
    from campovia.operators import routing
    from campovia.sources import readers

    pairs = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.1, 0.1)], "a long, b long, lat double, lon double, clat double, clon double")
    twice = spark.createDataFrame([(1, 2, 5.0, 9.0), (1, 2, 4.0, 8.0)], "a long, b long, km double, minutes double")
    got = routing.pair_costs(pairs, twice, [twice], ["a", "b"], ("lat", "lon", "clat", "clon"), 1.3, 35.0).collect()
    assert [(r.distancia_km, r.tempo_min, r.fonte) for r in got] == [(4.0, 8.0, "cache")]
    ceps = spark.createDataFrame([("1", "B", "SP"), ("1", "A", "SP"), ("2", "C", "X")], "cep string, cidade string, uf string")
    assert [tuple(r) for r in readers.resolved_ceps(ceps.select("cep"), ceps, [ceps]).collect()] == [("1", "A", "SP")]
