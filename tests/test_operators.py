"""Operators that SQL cannot express, by their invariants, and the edges of those that it can."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from campovia.operators import clean, dedup, filters, geocode, heuristics, nearest, routing, spatial, territory, upserts
from campovia.sources import readers, sinks

RNG = np.random.default_rng(5)
XY = np.column_stack([RNG.uniform(-25, -22, 60), RNG.uniform(-50, -45, 60)])


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.createDataFrame([(1 + i % 2, i, float(a), float(b)) for i, (a, b) in enumerate(XY)], "g int, id int, lat double, lon double").cache()


def test_kmeans_covers_and_is_repeatable():
    a, centres = heuristics.kmeans(XY, 5)
    assert set(a) == set(range(5)) and len(centres) == 5 and (a == heuristics.kmeans(XY, 5)[0]).all()
    assert len(set(heuristics.kmeans(np.zeros((4, 2)), 3)[0])) == 1


@pytest.mark.parametrize("most", [1, 7, 60])
def test_split_keeps_every_point_under_the_limit(most):
    parts = heuristics.split_to(XY, most)
    assert sorted(np.concatenate(parts)) == list(range(60)) and max(map(len, parts)) <= most
    same = heuristics.split_to(np.ones((10, 2)), 3)
    assert max(map(len, same)) <= 3 and sum(map(len, same)) == 10


def test_banded_assignment_is_optimal():
    d = RNG.uniform(0, 100, (7, 3))
    at, low_off, high_off = heuristics.banded_assignment(d, 2, 3)
    best = min(
        sum(d[i, j] for i, j in enumerate(c)) for c in itertools.product(range(3), repeat=7) if all(2 <= c.count(j) <= 3 for j in range(3))
    )
    assert abs(d[np.arange(7), at].sum() - best) < 0.01 and not low_off and not high_off
    assert heuristics.banded_assignment(d, 3, None)[1] and heuristics.banded_assignment(d, None, 2)[2]


def test_tours_are_permutations_and_two_opt_never_longer():
    start = XY.mean(0)
    order = heuristics.nearest_order(XY[:20], start)
    better = heuristics.two_opt_closed(XY[:20], order, start)
    assert sorted(order) == sorted(better) == list(range(20))
    assert heuristics.tour_km(XY[:20], better, start) <= heuristics.tour_km(XY[:20], order, start)
    assert heuristics.nearest_order(XY[:0], start) == [] and heuristics.tour_km(XY, [], start) == 0


def test_time_windows_hold():
    n = 12
    opens, closes = RNG.uniform(480, 600, n), RNG.uniform(700, 1000, n)
    closes[0] = 400
    found = heuristics.time_window_routes(XY[:n], XY[:n].mean(0), opens, closes, np.full(n, 10.0), np.arange(n) % 3 == 0, 4, 2, (480, 1400), 80.0, 1.0)
    assert found["dropped"] == [0] and sorted(sum(found["routes"], [])) == list(range(1, n))
    for route, times in zip(found["routes"], found["times"]):
        assert len(route) <= 4 and sum(i % 3 == 0 for i in route) <= 2
        assert all(opens[i] <= t <= closes[i] - 10 for i, t in zip(route, times))
    late = heuristics.time_window_routes(XY[:n], XY[:n].mean(0), opens, closes, np.full(n, 10.0), np.arange(n) % 3 == 0, 4, 2, (480, 1400), 80.0, 1.0, relaxed=True)
    assert late["dropped"] == [] and sorted(sum(late["routes"], [])) == list(range(n)) and any(late["fallback"])
    assert all(f for r, f in zip(late["routes"], late["fallback"]) if 0 in r)


@pytest.mark.parametrize("mode", list(routing.SPLITTERS))
def test_routes_partition_clusters(cloud, mode):
    got = routing.split_routes(cloud, ["g"], "id", "lat", "lon", mode, day_minutes=3000.0, day_km=2500.0, freq=4).toPandas()
    assert sorted(got.id) == list(range(60))
    for _, r in got.groupby(["g", "rota"]):
        assert sorted(r.seq) == list(range(1, len(r) + 1)) and (r.n_pdvs == len(r)).all()


def test_rebalanced_bands(cloud):
    swept = territory.sweep(cloud, "g", "id", "lat", "lon", 4)
    sizes = territory.rebalanced(swept, "g", "id", "lat", "lon", "label", 5, 9).groupBy("g", "label", "banda_status").count().toPandas()
    assert sizes["count"].sum() == 60 and sizes["count"].max() <= 9 and (sizes[sizes.banda_status == "OK"]["count"] >= 5).all()
    with pytest.raises(ValueError):
        territory.rebalanced(swept, "g", "id", "lat", "lon", "label", 9, 5)


def test_greedy_capacity(cloud, spark):
    staff = spark.createDataFrame([(1, -24.0, -48.0), (2, -23.0, -46.0)], "id int, lat double, lon double")
    got = territory.with_consultants(cloud, "g", "id", "lat", "lon", staff, None, 10, greedy=True).toPandas()
    assert len(got) == 60 and got[~got.excedente].groupby(["g", "consultor"]).size().max() == 10
    with pytest.raises(Exception, match="capacity"):
        territory.with_consultants(cloud, "g", "id", "lat", "lon", staff, None, 10, greedy=True, overflow=False).collect()


def test_nearest_centre_in_shards(cloud, spark, monkeypatch):
    c = spark.createDataFrame([(i, -20 - (i * 7 % 11) * 0.2, -50 + (i * 5 % 13) * 0.2) for i in range(40)], "cid int, clat double, clon double")
    whole = nearest.nearest_centre(cloud, c, "lat", "lon", "cid", "clat", "clon").orderBy("id").collect()
    monkeypatch.setattr(nearest, "CENTRES_AT_ONCE", 12)
    monkeypatch.setattr(nearest, "SHARD_POINTS", 7)
    assert nearest.nearest_centre(cloud, c, "lat", "lon", "cid", "clat", "clon").orderBy("id").collect() == whole
    assert nearest.nearest_centre(cloud, c.limit(0), "lat", "lon", "cid", "clat", "clon").where("cid IS NULL").count() == 60


def test_nearest_centre_without_coordinates(spark):
    p = spark.sql("SELECT * FROM VALUES (1, 0D, 179.9D, map('a', 1)), (2, null, 1D, null), (3, double('nan'), 1D, null), (4, 0D, 0D, null), (4, 0D, 0D, null) AS t(id, lat, lon, `a.b`)")
    c = spark.sql("SELECT * FROM VALUES (7, 0D, -179.9D), (9, 0D, 1D), (8, 0D, -1D), (5, null, 0D), (null, 0D, 0D), (10, 0D, -1D) AS t(cid, clat, clon)")
    got = [(r.id, r.cid, r.distancia_km and round(r.distancia_km, 3)) for r in nearest.nearest_centre(p, c, "lat", "lon", "cid", "clat", "clon").orderBy("id").collect()]
    assert got == [(1, 7, 22.239), (2, None, None), (3, None, None), (4, 8, 111.195), (4, 8, 111.195)]


@pytest.mark.parametrize("n", [1, 17, 1000, 100_000])
def test_centre_tree_reads_few_centres(n):
    """The nearest of all, by far fewer comparisons than points times centres."""
    rng = np.random.default_rng(n)
    lat, lon = rng.uniform(-30, 5, n), rng.uniform(-70, -35, n)
    lat[: n // 2] = rng.normal(-23.5, 0.1, n // 2)  # half of them in one town
    lon[: n // 2] = rng.normal(-46.6, 0.1, n // 2)
    q_lat, q_lon = np.concatenate([rng.uniform(-89, 89, 20), rng.uniform(-30, 5, 1500), lat[:30]]), np.concatenate([rng.uniform(-180, 180, 20), rng.uniform(-70, -35, 1500), lon[:30]])[: 1520 + min(n, 30)]
    tree = nearest.CentreTree(lat, lon)
    found, km = tree.nearest(q_lat, q_lon)
    for at in range(0, len(q_lat), 250):
        d = heuristics.km_matrix(np.stack([q_lat, q_lon], 1)[at : at + 250], np.stack([lat, lon], 1))
        assert (np.abs(d.min(1) - km[at : at + 250]) < 1e-9).all() and (d[np.arange(len(d)), found[at : at + 250]] <= d.min(1) + 1e-9).all()
    assert tree.measured <= len(q_lat) * min(n, 120)


def test_nearest_others_with_copies(spark):
    pts = [(i, -23.0, -46.0) for i in range(8)] + [(8, -24.0, -46.0), (9, 5.0, -60.0)]
    got = {r.id: r.kms for r in spatial.nearest_others(spark.createDataFrame(pts, "id int, lat double, lon double"), "id", "lat", "lon", 3).collect()}
    assert got[0] == [0.0, 0.0, 0.0] and len(got[9]) == 3 and abs(got[8][0] - 111.19) < 0.01
    few = spark.createDataFrame(pts[8:], "id int, lat double, lon double")
    assert {r.id: len(r.kms) for r in spatial.nearest_others(few, "id", "lat", "lon", 3).collect()} == {8: 1, 9: 1}
    assert spatial.nearest_others(few.limit(0), "id", "lat", "lon", 3).count() == 0
    assert spatial.flag_outliers(few, "id", "lat", "lon").where("is_outlier").count() == 0


def test_polygon_buffer_edges_and_unknown_places(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    polygons = spark.createDataFrame([("A", [[{"lon": x, "lat": y} for x, y in ring]])], "city string, rings array<array<struct<lon: double, lat: double>>>")
    cases = [(1, "A", 0.5, 0.5, True), (2, "A", 0.5, 1.004, True), (3, "A", 0.5, 1.006, False), (4, "A", 1.0, 1.0, True), (5, "B", 0.5, 0.5, None), (6, "A", None, 0.5, False)]
    pts = spark.createDataFrame([c[:4] for c in cases], "id int, city string, lat double, lon double")
    got = {r.id: r.dentro for r in spatial.point_in_place(pts, polygons, ["city"], "lat", "lon").collect()}
    assert got == {c[0]: c[4] for c in cases}


def test_guarded_upsert_and_order(spark):
    old = spark.createDataFrame([("a", 1.0, "manual_edit"), ("b", 2.0, None)], "k string, v double, origem string")
    new = spark.createDataFrame([("a", 9.0, "pipeline"), ("b", 8.0, "pipeline"), ("c", 7.0, "pipeline")], "k string, v double, origem string")
    got = {r.k: (r.v, r.origem) for r in upserts.guarded_upsert(old, new, "k", ["v"], "origem").collect()}
    assert got == {"a": (1.0, "manual_edit"), "b": (8.0, "pipeline"), "c": (7.0, "pipeline")}


def test_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "id int, k string")
    once, often = dedup.split_repeated(rows, ["k"])
    assert [r.id for r in once.collect()] == [5] and sorted(r.id for r in often.collect()) == [1, 2, 3, 4]


def test_columns_and_reasons(spark):
    df = spark.createDataFrame([("1", " ", None)], "`CNPJ ` string, Cidade string, `Tempo Serviço (min)` string")
    named = filters.canonical_columns(df)
    assert named.columns == ["cnpj", "cidade", "tempo_atendimento_min"]
    bad = filters.split_required(named, ["cnpj", "cidade"])[1].first()
    assert bad.motivo_invalidade == "campo_obrigatorio_cidade"
    with pytest.raises(ValueError, match="cep"):
        filters.assert_columns(named, ["cep"])
    with pytest.raises(ValueError):
        filters.guard_size(named.union(named), 1)


def test_clean_points_edges(spark):
    head = ["linha", "CNPJ", "Logradouro", "Número", "Cidade", "UF", "CEP", "Abertura"]
    rows = [
        (0, "", "Rua A, 10", "", "x", "sp", "01310-100", "08:00"),
        (1, "11.222.333/0001-81", "Rua B 20", "s/n", "x", "sp", "1", "25:00"),
        (2, "11222333000181", "Rua C", "5", "x", "sp", "", ""),
        (3, "11444777000161", "nan", "5", "x", "", "", ""),
    ]
    good, bad = clean.clean_points(spark.createDataFrame(rows, head), "linha")
    first = good.collect()
    assert [r.linha for r in first] == [0] and len(first[0].cnpj) == 14 and first[0].janela_atendimento_inicio == 480
    lacking = (3, "campo_obrigatorio_logradouro|campo_obrigatorio_uf")
    assert {(r.linha, r.motivo_invalidade) for r in bad.collect()} == {(1, "cnpj_duplicado_arquivo"), lacking}
    good, bad = clean.clean_points(spark.createDataFrame(rows[:1] + rows[2:], head), "linha", stored=spark.createDataFrame([("11222333000181",)], ["cnpj"]))
    assert [r.linha for r in good.collect()] == [0] and {(r.linha, r.motivo_invalidade) for r in bad.collect()} == {(2, "cnpj_duplicado_input_id"), lacking}


def test_geocode_falls_back_and_fans_out(spark):
    a = spark.createDataFrame([(1, "Rua A", "1", "x", "SP"), (2, "Rua A", "1", "X", "sp"), (3, "", "1", "x", "SP")], "id int, logradouro string, numero string, cidade string, uf string")
    key = "RUA A 1, X - SP"
    cache = spark.createDataFrame([(key, 10.0, 10.0)], "key string, lat double, lon double")
    provider = spark.createDataFrame([(key, -23.0, -47.0, "house")], "key string, lat double, lon double, kind string")
    got = {r.id: (r.source, r.lat) for r in geocode.geocode_batch(a, cache, [("nominatim", provider)]).collect()}
    assert got == {1: ("nominatim", -23.0), 2: ("nominatim", -23.0), 3: ("invalid_input", None)}


def test_csv_encodings_and_geojson(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("nome;cidade\nJoão;São\n".encode("latin-1"))
    assert readers.csv_sheet(spark, str(path)).first().nome == "João"
    path.write_bytes("﻿nome,cidade\nJoão,\n".encode())
    row = readers.csv_sheet(spark, str(path)).first()
    assert row.nome == "João" and row.cidade == ""
    line = spark.createDataFrame([(1, [(1.0, 2.0), (3.0, 4.0)]), (2, [(1.0, 2.0)])], "id int, p array<struct<lat: double, lon: double>>")
    text = sinks.feature_collection(line.select("id", sinks.line_feature(F.col("p"), id=F.col("id")).alias("f")), "f", ["id"]).first().geojson
    assert json.loads(text)["features"][0]["geometry"] == {"type": "LineString", "coordinates": [[2.0, 1.0], [4.0, 3.0]]} and len(json.loads(text)["features"]) == 1


def test_retries():
    tries = []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert readers.with_retries(action, delay=0.001) == "ok" and len(tries) == 3


def test_medoid_in_blocks(cloud, monkeypatch):
    whole = sorted(territory.medoid(cloud, "g", "id", "lat", "lon").collect())
    monkeypatch.setattr(territory, "MEDOID_BLOCK", 7)
    assert sorted(territory.medoid(cloud, "g", "id", "lat", "lon").collect()) == whole
    d = heuristics.km_matrix(XY[::2], XY[::2]).sum(1)
    assert whole[0].medoid == 2 * int(d.argmin())
