"""Tables whose keys go beyond the round of coordinates, and groups larger than at the small scales."""

import time
import tracemalloc

import numpy as np
import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from campovia.operators import heuristics as h
from campovia.operators import routing, spatial, territory
from campovia.operators.nearest import nearest_centre
from campovia.operators.territory import DEFAULTS
from campovia.plans import base, catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def rounds(spark, tmp_path_factory):
    """The customers four times, the copies at the same places."""
    folder = str(tmp_path_factory.mktemp("rounds"))
    customer = spark.read.parquet(f"{FOLDER}/customer.parquet")
    turns = customer.crossJoin(spark.range(4).withColumnRenamed("id", "turn"))
    turns.withColumn("c_custkey", F.col("c_custkey") + F.col("turn") * base.ROUND).drop("turn").write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", ["geo17_reverse_lookup", "geo18_district_lookup", "geo18_districts", "rt06_filled_cache"])
def test_shared_places(spark, rounds, name):
    ours, theirs = QUERIES[name](spark, rounds).toPandas(), connect(rounds).execute(SQL[name]).fetchdf()
    assert rows(ours) == rows(theirs)


def scattered(n):
    """Places as the queries derive them, some of them shared."""
    key = np.random.default_rng(5).integers(0, 10**6, n)
    xy = np.stack([-25 + key * 7919 % 60000 / 1e4, -53 + key * 104729 % 80000 / 1e4], axis=1)
    xy[n // 4 : n // 4 + 10] = xy[n // 2]
    return xy


def test_tours_by_tiles(monkeypatch):
    xy = scattered(1200)
    tiles = h.nearest_order(xy, xy.mean(0))
    monkeypatch.setattr(h, "TILED", 10**9)
    assert tiles == h.nearest_order(xy, xy.mean(0))


def test_long_tours_take_little_memory():
    """A tour's length needs its legs, not a matrix of all its stops."""
    xy = scattered(5000)
    tracemalloc.start()
    h.route(xy, xy.mean(0), 35.0, 30.0, 1.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_points_of_one_file_are_searched_by_many_tasks(spark):
    points = spark.range(2000).select("id", (F.col("id") % 40 / 10.0).alias("lat"), (F.col("id") * 7 % 50 / 10.0).alias("lon")).coalesce(1)
    centres = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 3.0)], "cid long, clat double, clon double")
    found = nearest_centre(points, centres, "lat", "lon", "cid", "clat", "clon")
    assert found.rdd.getNumPartitions() > 1 and found.count() == 2000


@pytest.mark.parametrize("extra", [0, 1])
def test_kmeans_of_near_centres(monkeypatch, extra):
    """The same labels and centres as by comparing all with all, copies of points too; a step holds no matrix of points and centres."""
    x = np.random.default_rng(3).normal(size=(1500, 2 + extra))
    x[100:140] = x[7]
    labels, centres = h.kmeans(x, 60)
    monkeypatch.setattr(h, "DENSE", 0)
    near = h.kmeans(x, 60)
    assert (near[0] == labels).all() and np.allclose(near[1], centres, rtol=0, atol=1e-12)


def test_large_kmeans_takes_little_memory(monkeypatch):
    monkeypatch.setattr(h, "STARTS", 1)
    monkeypatch.setattr(h, "STEPS", 3)
    x = np.random.default_rng(3).normal(size=(20000, 2))
    tracemalloc.start()
    labels, centres = h.kmeans(x, 800)
    h.redistribute(x, labels, centres, 25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # a matrix of all with all has 128 MB


def test_redistributed_as_by_all_distances():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 2)) * 0.3, rng.uniform(-2, 2, size=(200, 2))])
    labels, centres = h.kmeans(x, 16)
    want, load, away = labels.copy(), np.bincount(labels, minlength=16), np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    while load.max() > 25 and (load < 25).any():
        source, takers = int(load.argmax()), np.flatnonzero(load < 25)
        own = np.flatnonzero(want == source)
        border = own[away[np.ix_(own, takers)].argmin(axis=0)]
        stretch = away[border, takers] / away[border, source]
        if stretch.min() > 2:
            break
        best = int(stretch.argmin())
        want[border[best]] = takers[best]
        load = np.bincount(want, minlength=16)
    assert (h.redistribute(x, labels, centres, 25) == want).all() and (want != labels).any()


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Two states of more points than the public run takes."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    columns = [F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), (F.col("id") % 2).cast("int").alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")]
    spark.range(6200).select(*columns).write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", ["cl27_dispatch_sweep", "cl27_dispatch_fixed", "cl27_dispatch_capacity", "cl16_cl27_dispatch_operational", "cl12_cl27_dispatch_nearest"])
def test_dispatch_of_large_states(spark, crowded, name):
    assert QUERIES[name](spark, crowded).select("id").distinct().count() > 6100


@pytest.mark.parametrize("limits", [(300.0, 5000.0), (5000.0, 900.0), (20.0, 10.0)])
def test_iterative_split_tries_what_can_hold(monkeypatch, limits):
    """The groups of trying every number of routes, without the numbers that the service time alone rules out."""
    xy, s, tried = scattered(60), DEFAULTS | {"alpha": 1.3, "day_minutes": limits[0], "day_km": limits[1]}, []
    holds = lambda g: (lambda r: r["minutes"] <= limits[0] and r["km"] <= limits[1])(h.route(xy[g], xy[g].mean(0), s["kmh"], s["service"], s["alpha"]))
    for k in range(1, 61):
        labels = h.kmeans(xy, k)[0]
        want = [np.flatnonzero(labels == j) for j in np.unique(labels)]
        if all(map(holds, want)):
            break
    kmeans = h.kmeans
    monkeypatch.setattr(h, "kmeans", lambda x, k: tried.append(k) or kmeans(x, k))
    got = routing.split_iterative(xy, np.ones(60), s)
    assert [g.tolist() for g in got] == [g.tolist() for g in want] and min(tried) >= min(60, 60 * s["service"] / (limits[0] + 30))


@pytest.mark.parametrize("kept", [h.KEPT, 0, 300_000])
def test_kmeans_of_one_centre_more_is_a_run_of_its_own(monkeypatch, kept):
    """Labels of every number of centres, copies of points and steps that end early or late too, whether the steps fit in memory or not."""
    monkeypatch.setattr(h, "DENSE", 0)
    monkeypatch.setattr(h, "KEPT", kept)
    rng = np.random.default_rng(15)
    flat = np.round(rng.random((120, 2)) * 20)  # many equal distances
    for xy, first, numbers, steps in ((scattered(400), 20, 12, 100), (rng.normal(size=(200, 3)), 30, 8, 100), (flat, 90, 100, 100), (scattered(400), 40, 8, 4)):
        monkeypatch.setattr(h, "STEPS", steps)
        k = 0
        for k, labels in zip(range(first, first + numbers), h.kmeans_rising(xy, first)):
            assert (labels == h.kmeans(xy, k)[0]).all()
        assert k == min(first + numbers - 1, len(np.unique(xy, axis=0)))


def test_iterative_split_makes_each_number_of_routes_from_the_one_before(monkeypatch):
    """As by a k-means for each number; none is run from its start again."""
    xy, s = scattered(400), DEFAULTS | {"alpha": 1.3, "day_minutes": 3000.0, "day_km": 2000.0}
    monkeypatch.setattr(h, "DENSE", 0)
    for k in range(17, 401):
        want = routing._kmeans_groups(xy, k)
        if all(r["minutes"] <= 3000 and r["km"] <= 2000 for _, r in routing._routes(want, xy, s, False)):
            break
    calls, near = [], h._kmeans_near
    monkeypatch.setattr(h, "_kmeans_near", lambda *a: calls.append(a) or near(*a))
    got = routing.split_iterative(xy, np.ones(400), s)
    assert [g.tolist() for g in got] == [g.tolist() for g in want] and len(want) > 20 and not calls


@pytest.mark.parametrize("minutes", [5000.0, 2500.0, 1500.0, 700.0, 20.0])
def test_iterative_split_in_parts_is_that_of_all_numbers(spark, minutes):
    """The first part that holds is the first number that holds; one of them always counts."""
    xy, s = scattered(120), DEFAULTS | {"alpha": 1.3, "day_minutes": minutes, "day_km": 2000.0}
    want = [g.tolist() for g in routing.split_iterative(xy, np.ones(120), s)]
    parts = [routing.split_iterative(xy, np.ones(120), s, p) for p in range(len(routing.PARTS))]
    assert [g.tolist() for g in next(filter(len, parts))] == want
    frame = spark.createDataFrame([(None if i % 2 else "a", int(i), *map(float, p)) for i, p in enumerate(np.repeat(xy, 2, axis=0))], "g string, id long, lat double, lon double")
    found = routing.split_routes(frame, ["g"], "id", "lat", "lon", "iterativo", day_minutes=minutes, day_km=2000.0).toPandas()
    for _, own in found.groupby("g", dropna=False):
        assert [sorted(r["id"] // 2) for _, r in own.groupby("rota")] == want


def test_iterative_split_of_a_place_over_its_day_tries_one_number(monkeypatch):
    """A place of more visits than a day takes: no number of routes can hold, so only the last is made."""
    xy, s, tried = np.concatenate([scattered(300), np.tile([[-22.5, -47.25]], (90, 1))]), DEFAULTS | {"alpha": 1.3, "day_minutes": 2500.0, "day_km": 2000.0}, []
    kmeans = h.kmeans
    want = routing._kmeans_groups(xy, len(xy))
    monkeypatch.setattr(h, "kmeans", lambda x, k: tried.append(k) or kmeans(x, k))
    got = routing.split_iterative(xy, np.ones(390), s)
    assert [g.tolist() for g in got] == [g.tolist() for g in want] and len(tried) == 1


def _by_all_pairs(xy, eps, least):
    close = [np.flatnonzero(((xy - p) ** 2).sum(1) <= eps * eps) for p in xy]
    labels = np.full(len(xy), -1)
    for i in range(len(xy)):
        if labels[i] < 0 and len(close[i]) >= least:
            own = labels[i] = labels.max() + 1
            todo = [i]
            while todo:
                for j in close[todo.pop()]:
                    if labels[j] < 0:
                        labels[j] = own
                        if len(close[j]) >= least:
                            todo.append(j)
    return labels


@pytest.mark.parametrize("eps,least", [(0.3, 3), (0.1, 2), (0.9, 10), (0.5, 40), (0.1, 1)])
def test_dbscan_by_cells_is_dbscan_by_pairs(eps, least):
    rng = np.random.default_rng(5)
    for xy in (rng.random((500, 2)) * 8, np.round(rng.random((400, 2)) * 6, 1), rng.random((100, 2))[rng.integers(0, 100, 600)] * 5):
        assert (h.dbscan(xy, eps, least) == _by_all_pairs(xy, eps, least)).all()


def test_dbscan_of_a_dense_group_looks_at_no_pairs():
    """60,000 points, a third of which are near each: their pairs would be a billion numbers."""
    start = time.monotonic()
    assert (h.dbscan(np.random.default_rng(6).random((60_000, 2)), 0.4, 3) == 0).all()
    assert time.monotonic() - start < 20


def test_assignment_measures_only_what_a_row_changes():
    rng = np.random.default_rng(11)
    start = time.monotonic()
    at, low_off, high_off = h.banded_assignment(rng.random((12_000, 20)) * 100, 1, 4)
    assert time.monotonic() - start < 12 and not low_off and high_off and np.bincount(at, minlength=20).min() >= 1


def test_many_small_groups_are_joined_without_making_all_anew():
    xy = np.random.default_rng(10).random((12_000, 2))
    start = time.monotonic()
    joined = h._joined(xy, [np.array([i]) for i in range(12_000)], 4, 8)
    assert time.monotonic() - start < 30
    assert sorted(np.concatenate(joined)) == list(range(12_000)) and min(map(len, joined)) >= 4


def test_copies_of_places_are_one_point_of_their_weight(monkeypatch):
    rng = np.random.default_rng(7)
    spots = rng.random((300, 2))
    own = rng.integers(0, 300, 9000)
    seen, means = [], h._means
    monkeypatch.setattr(h, "_means", lambda x, *rest: seen.append(len(x)) or means(x, *rest))
    labels, centres = h.kmeans(spots[own], 12)
    assert max(seen) == len(np.unique(own))
    assert (h.km_matrix(spots[own], centres).argmin(1) == labels).mean() > 0.99
    assert np.allclose(centres, [spots[own][labels == j].mean(0) for j in range(12)], atol=1e-9)


def test_a_tour_visits_the_points_of_a_place_together():
    spots = np.random.default_rng(8).random((90, 2)) * 5
    xy = spots[np.random.default_rng(9).integers(0, 90, 1500)]
    left, here, wanted = list(range(1500)), xy.mean(0), []
    while left:
        i = int(h.km_matrix(here[None], xy[left])[0].argmin())
        wanted.append(left.pop(i))
        here = xy[wanted[-1]]
    assert h.nearest_order(xy, xy.mean(0)) == wanted


def test_a_group_over_its_most_is_cut_before_it_is_routed(monkeypatch):
    """theoretical_routes: what is over `most` cannot hold, so its days are not made."""
    made = []
    monkeypatch.setattr(territory, "labelled", lambda df, group, key, lat, lon, fn: fn)
    monkeypatch.setattr(h, "route", lambda xy, *rest: made.append(len(xy)) or {"minutes": 0, "km": 0})
    labels = territory.theoretical_routes(None, "g", "k", "a", "b", 30)(np.random.default_rng(12).random((400, 2)))
    assert len(labels) == 400 and sum(made) <= 400


def test_the_medoid_is_measured_on_places(spark, monkeypatch):
    """1,200 points of 40 places, some of them alone: blocks hold places, and weights count the points."""
    rng = np.random.default_rng(13)
    xy = (rng.random((40, 2)) * 5)[rng.integers(0, 40, 1200) ** 2 // 40]
    frame = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xy)], "g long, id long, lat double, lon double")
    total = np.round(h.km_matrix(xy, xy).sum(axis=1), 6)
    monkeypatch.setattr(territory, "MEDOID_BLOCK", 10)
    found = territory.medoid(frame, "g", "id", "lat", "lon")
    got = found.collect()
    best = int(total.argmin())
    same = np.flatnonzero((xy == xy[best]).all(axis=1))
    assert [(r.g, r.medoid, r.mlat, r.mlon) for r in got] == [(1, int(same.min()), *xy[best])]
    assert "_copies" in found._jdf.queryExecution().analyzed().toString()


def test_slopes_bound_the_sums_of_distances():
    """At places of all the earth and near by, by marks that are measured in two parts."""
    rng = np.random.default_rng(16)
    globe = np.c_[np.degrees(np.arcsin(rng.random(300) * 2 - 1)), rng.random(300) * 360 - 180]
    for xy in (globe, globe / 20, globe / 1e4, np.vstack([globe[:40], globe[:40] + 1e-7]), np.c_[90 - rng.random(100) / 5, rng.random(100) * 360 - 180], np.c_[rng.random(100), 179.9 + rng.random(100) / 5 % 0.2 - 360 * (rng.random(100) < 0.5)]):
        weight = rng.integers(1, 9, len(xy)).astype(float)
        exact = (h.km_matrix(xy, xy) * weight).sum(1)
        halves = [h.distance_slopes(xy[:60], xy[part], weight[part]) for part in (slice(0, 30), slice(30, None))]
        found = np.array([a + b for a, b in zip(*halves)]).T
        least = h.least_sums(xy, xy[:60], found, weight.sum())
        assert np.allclose(found[:, 0], exact[:60]) and (least <= exact * (1 + 1e-9) + weight.sum() * 1e-9).all() and np.allclose(least[:60], exact[:60], atol=weight.sum() * 0.03)


def test_the_medoid_is_searched_among_few_places(spark, monkeypatch):
    """As by all pairs: even, in two towns, on a line, on a circle, around the earth, copies in one place, equal sums, a place that is none, a lone point; of the even group hardly a place is left."""
    rng = np.random.default_rng(17)
    turn = np.arange(200) * 2 * np.pi / 200
    groups = [
        rng.random((3000, 2)) * [6, 8] + [-25, -53], np.vstack([rng.random((150, 2)), rng.random((150, 2)) + 30]), np.c_[np.full(300, -20.0), rng.random(300) * 9], np.c_[np.cos(turn), np.sin(turn)],
        np.c_[np.degrees(np.arcsin(rng.random(300) * 2 - 1)), rng.random(300) * 360 - 180], np.vstack([rng.random((200, 2)) * 3, np.tile([[1.0, 7.0]], (400, 1))]), np.array([[0.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 1.0]]),
        np.vstack([rng.random((50, 2)), [[200.0, 3.0]]]), np.array([[3.0, 4.0]]),
    ]
    frame = spark.createDataFrame([(g, 10_000 * g + i, *map(float, p)) for g, xy in enumerate(groups) for i, p in enumerate(xy)], "g long, id long, lat double, lon double")
    left, once = [], territory._medoid_round

    def round_(*args):
        found = once(*args)
        left.append(dict(found[0].groupBy("g").count().collect()))
        return found

    monkeypatch.setattr(territory, "_medoid_round", round_)
    monkeypatch.setattr(territory, "MEDOID_PAIRS", 0)
    monkeypatch.setattr(territory, "MEDOID_FEW", 1)
    got = {r.g: (r.medoid, r.mlat, r.mlon) for r in territory.medoid(frame, "g", "id", "lat", "lon").collect()}
    for g, xy in enumerate(groups):
        total = np.round(h.km_matrix(xy, xy).sum(axis=1), 6)
        if g == 3:  # all sums are equal but for rounding
            assert total[got[g][0] - 10_000 * g] <= total.min() * (1 + 1e-12)
        else:
            assert got[g] == (10_000 * g + int(total.argmin()), *xy[total.argmin()])
    assert left[-1][0] < 60 and left[-1][7] == 51


def test_radius_pairs_meet_in_all_tasks(spark):
    """Pairs near the limit, at the poles and across the date line, from cells dealt to a fixed number of tasks."""
    rng = np.random.default_rng(14)
    a = np.vstack([np.c_[rng.random(60) * 2 - 24, rng.random(60) * 2 - 50], np.c_[89.5 + rng.random(20) / 2, rng.random(20) * 360 - 180], np.c_[rng.random(20), 179.5 + rng.random(20) % 0.5], np.c_[rng.random(20), -180 + rng.random(20) / 2]])
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "a long, alat double, alon double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "b long, blat double, blon double")
    pairs = spatial.within_km(left, right, 40.0, "alat", "alon", "blat", "blon")
    km = h.km_matrix(a, a)
    assert {(r.a, r.b) for r in pairs.collect()} == {(int(i), int(j)) for i, j in np.argwhere(km <= 40)}
    assert pairs.columns == ["a", "alat", "alon", "b", "blat", "blon", "km"]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
