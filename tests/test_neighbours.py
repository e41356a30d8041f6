"""Nearest neighbours and radius joins against all pairs."""

import numpy as np
import pytest

from campovia.operators import heuristics as h
from campovia.operators import nearest, spatial


def table(spark, lat, lon):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "id int, lat double, lon double").repartition(4)


@pytest.mark.parametrize("shard", [100_000, 40])
def test_dense_places(spark, monkeypatch, shard):
    """Half of all points in one town, many at one place; shards of places, however dense, hold what they may."""
    monkeypatch.setattr(nearest, "SHARD_PLACES", shard)
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(-60, 60, 400), rng.uniform(-180, 180, 400)
    lat[:200], lon[:200] = rng.normal(-23.5, 0.01, 200), rng.normal(-46.6, 0.01, 200)
    lat[200:230], lon[200:230] = 10.0, 179.99
    df = table(spark, lat, lon).unionByName(spark.sql("SELECT 900 AS id, CAST(null AS DOUBLE) AS lat, 1D AS lon"))
    got = {r.id: r.kms for r in spatial.nearest_others(df, "id", "lat", "lon", 5).collect()}
    d = h.km_matrix(np.stack([lat, lon], 1), np.stack([lat, lon], 1))
    np.fill_diagonal(d, np.inf)
    assert got.pop(900) is None and len(got) == 400
    assert np.abs(np.array([got[i] for i in range(400)]) - np.sort(d, axis=1)[:, :5]).max() < 1e-9


def test_few_points(spark):
    got = {r.id: r.kms for r in spatial.nearest_others(table(spark, [0, 0, 1], [0, 0, 0]), "id", "lat", "lon", 5).collect()}
    assert [len(got[i]) for i in range(3)] == [2, 2, 2] and got[0][0] == 0.0
    assert spatial.nearest_others(table(spark, [0], [0]), "id", "lat", "lon", 5).first().kms == []
    assert spatial.nearest_others(table(spark, [0], [0]).limit(0), "id", "lat", "lon", 5).count() == 0


def test_tree_keeps_to_few_distances():
    rng = np.random.default_rng(3)
    lat, lon = rng.normal(-23.5, 0.01, 50_000), rng.normal(-46.6, 0.01, 50_000)
    tree = nearest.CentreTree(lat, lon)
    best = tree.k_nearest(lat[:500], lon[:500], 6)
    d = np.sort(h.km_matrix(np.stack([lat, lon], 1)[:500], np.stack([lat, lon], 1)), axis=1)[:, :6]
    assert np.abs(best - d).max() < 1e-9 and tree.measured < 500 * 400


@pytest.mark.parametrize("km", [3.0, 150.0, 2500.0])
def test_radius_at_all_latitudes(spark, km):
    """No pair is lost near the poles or across the date line, and none comes twice."""
    rng = np.random.default_rng(int(km))
    lat, lon = np.concatenate([rng.uniform(-90, 90, 150), [90, -90, 89.99, 89.99, -89.9, 0, 0, 70, 70]]), np.concatenate([rng.uniform(-180, 180, 150), [0, 50, 10, -170, 179, 180, -179.99, 179.99, -179.99]])
    near = np.concatenate([lat, lat + rng.uniform(-0.01, 0.01, len(lat)).clip(-90 - lat, 90 - lat)]), np.concatenate([lon, lon + rng.uniform(-0.01, 0.01, len(lon))])
    a, b = table(spark, lat, lon), table(spark, *near).toDF("other", "rlat", "rlon")
    got = sorted((r.id, r.other) for r in spatial.within_km(a, b, km, "lat", "lon", "rlat", "rlon").collect())
    d = h.km_matrix(np.stack([lat, lon], 1), np.stack(near, 1))
    clear = np.abs(d - km) > 1e-6
    assert [p for p in got if clear[p]] == [tuple(map(int, p)) for p in np.argwhere((d <= km) & clear)]
