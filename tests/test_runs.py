"""Whole runs, lines, block matrices, cache administration and snapshots against plain Python, with failures planted."""

import itertools
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from campovia.operators import cache_admin, geocode, heuristics, lines, numbering, reports, routing, runs, snapshots
from campovia.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()
SHEET = "consultor string, id long, lat double, lon double, cnpj string, zz string"
BASES = "consultor string, lat double, lon double"
SEEN = "id long, chave string, endereco string, lat double, lon double, origem string, versao long"
ASKED = "pedido long, chave string, endereco string, lat double, lon double"
CHANGE = "pedido long, id long, versao long, chave string, endereco string, lat double, lon double"


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b - d) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def tour(stops, start):
    line = [start, *stops, start]
    return sum(km(*a, *b) for a, b in zip(line, line[1:]))


# ---- numbers -----------------------------------------------------------------------------------------------------


def test_running_sums_over_ranges(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    got = numbering.numbered(spark.createDataFrame(rows, "k long, w long"), ["k"], "n", step=numbering.F.col("w")).collect()
    assert {r.k: r.n for r in got} == dict(zip((k for k, _ in sorted(rows)), [0, *itertools.accumulate(w for _, w in sorted(rows))]))
    assert numbering.numbered(spark.createDataFrame([], "k long"), ["k"], "n").collect() == []


# ---- runs --------------------------------------------------------------------------------------------------------


def sheet(spark, extra=()):
    rng = np.random.default_rng(5)
    rows = [(f" {g} ", 100 * n + i, *map(float, rng.uniform(-25, -20, 2)), "x", "own") for n, g in enumerate(["ana", "bia", "caio"]) for i in range(20)]
    return spark.createDataFrame([*rows, *extra], SHEET)


def bases(spark, *names):
    return spark.createDataFrame([(n, -22.0, -22.5) for n in names], BASES)


def test_outputs_of_a_run(spark):
    bad = [(None, 900, -22.0, -22.0, "x", None), ("ana", 901, None, -22.0, "x", None), ("ana", 902, float("nan"), -22.0, " ", None), ("bia", 903, -95.0, 0.0, "x", None), (None, None, None, None, None, None)]
    run = runs.route_run(sheet(spark, bad), "consultor", "id", "lat", "lon", bases(spark, "ANA", "bia ", "Caio"), ["cnpj"], least=4, most=8, freq=4)
    why = {r.id: r.motivo_invalidade for r in run.rejects.collect()}
    assert why == {900: "campo_obrigatorio_consultor", 901: "coordenadas_invalidas", 902: "campo_obrigatorio_cnpj|coordenadas_invalidas", 903: "coordenadas_invalidas", None: "campo_obrigatorio_cnpj|campo_obrigatorio_consultor|coordenadas_invalidas"}
    detail, summary = run.detail.toPandas(), run.summary.toPandas()
    assert sorted(detail.id) == [100 * n + i for n in range(3) for i in range(20)]
    order = summary.assign(n=summary.rota_id.str[1:].astype(int)).sort_values("n")
    assert order.n.tolist() == list(range(1, len(order) + 1)) and order.grupo_utilizado.is_monotonic_increasing
    for _, r in summary.iterrows():
        own = detail[detail.rota_id == r.rota_id].sort_values("sequencia")
        assert own.sequencia.tolist() == list(range(1, r.qtd_pdvs + 1)) and set(own.grupo_utilizado) == {r.grupo_utilizado}
        length = tour(own[["lat", "lon"]].values.tolist(), (-22.0, -22.5)) * 1.3
        assert abs(length - r.distancia_km) < 0.006 and abs(length + 30 * r.qtd_pdvs - r.tempo_min) < 0.06  # 60 km/h, half an hour a stop
    m = run.metrics.first()
    assert (m.total_pdvs_validos, m.total_pdvs_invalidos, m.total_grupos, m.grupos_processados, m.grupos_com_erro, m.total_rotas, m.taxa_sucesso) == (60, 5, 3, 3, 0, len(summary), 100.0)
    assert run.status.first().status == "done" and run.failures.count() == 0


def test_a_failed_group_leaves_the_others_standing(spark, monkeypatch):
    whole = runs.SPLITTERS["balanceado"]

    def breaks(xy, visits, s):
        if len(xy) == 21:
            raise ValueError("planted")
        return whole(xy, visits, s)

    monkeypatch.setitem(runs.SPLITTERS, "planted", breaks)
    more = [("bia", 990, -22.0, -22.0, "x", None), *[("davi", 2000 + i, -22.0, -22.0, "x", None) for i in range(30)]]
    places = spark.createDataFrame([("ana", -22.0, -22.5), ("bia", -22.0, -22.5), ("caio", None, -22.5), ("davi", -22.0, -22.5)], BASES)
    run = runs.route_run(sheet(spark, more), "consultor", "id", "lat", "lon", places, ["cnpj"], most_points=25, mode="planted")
    assert {r.grupo_utilizado: (r.qtd_pdvs, r.erro) for r in run.failures.collect()} == {"BIA": (21, "planted"), "CAIO": (20, "Consultor sem coordenadas: CAIO"), "DAVI": (30, "Grupo grande demais: DAVI")}
    assert {r.grupo_utilizado for r in run.detail.collect()} == {"ANA"} and run.detail.count() == 20
    assert run.status.first().asDict() == {"status": "done_with_warnings", "total_grupos": 4, "grupos_processados": 1, "grupos_com_erro": 3}
    assert run.metrics.first().taxa_sucesso == 25.0


def test_runs_of_nothing_and_of_failures_alone(spark):
    none = runs.route_run(sheet(spark).limit(0), "consultor", "id", "lat", "lon", bases(spark, "ana"), ["cnpj"])
    assert none.status.first().status == "done" and none.metrics.first().taxa_sucesso == 0 and none.detail.count() == none.summary.count() == 0
    lost = runs.route_run(sheet(spark), "consultor", "id", "lat", "lon", bases(spark, "zoe"), ["cnpj"])
    assert lost.status.first().status == "partial_failed" and lost.failures.count() == 3
    with pytest.raises(ValueError, match="unknown mode"):
        runs.route_run(sheet(spark), "consultor", "id", "lat", "lon", bases(spark, "ana"), ["cnpj"], mode="nothing")


def test_bases_with_and_without_places(spark):
    """Of several rows of a consultant one with coordinates counts; one place for several consultants is theirs all."""
    places = spark.createDataFrame([("ana", None, None), ("ana", -22.0, -22.5), ("bia", 200.0, 0.0), ("caio", -22.0, -22.5)], BASES)
    run = runs.route_run(sheet(spark), "consultor", "id", "lat", "lon", places, ["cnpj"])
    assert [r.grupo_utilizado for r in run.failures.collect()] == ["BIA"]


def test_registered_run_covers_every_row(spark):
    got = {n: QUERIES[f"rt17_run_{n}"](spark, FOLDER).toPandas() for n in ("rejects", "detail", "summary", "metrics")}
    failed = QUERIES["rt18_run_failures"](spark, FOLDER).toPandas()
    assert len(got["rejects"]) + len(got["detail"]) + failed.qtd_pdvs.sum() == 150 and got["detail"].id.is_unique
    m = got["metrics"].iloc[0]
    assert m.total_rotas == len(got["summary"]) == got["detail"].rota_id.nunique() and m.total_pdvs_validos == len(got["detail"]) + failed.qtd_pdvs.sum()
    assert got["summary"].qtd_pdvs.sum() == len(got["detail"])


def test_status_of_a_split(spark):
    status = lambda *s: routing.run_status(spark.createDataFrame([(x,) for x in s], "status string")).first().status
    assert [status("OK"), status("OK", "EXCEDIDO"), status("OK", "erro: x"), status("erro: x", "erro: y")] == ["done", "done_with_warnings", "done_with_warnings", "partial_failed"]


# ---- orders of stops ---------------------------------------------------------------------------------------------


def open_km(xy, order):
    return sum(km(*xy[a], *xy[b]) for a, b in zip(order, order[1:]))


def reversals(order):
    return [order[:i] + order[i:j][::-1] + order[j:] for i in range(1, len(order) - 2) for j in range(i + 2, len(order))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9, 14])
def test_reversals_of_open_paths(n):
    for seed in range(5):
        xy = np.random.default_rng(seed).uniform(-25, -20, (n, 2))
        order = list(range(n))
        lengths = [open_km(xy, o) for o in [order, *reversals(order)]]
        one = heuristics.two_opt_single(xy, order)
        assert abs(open_km(xy, one) - min(lengths)) < 1e-9 and sorted(one) == order
        many = heuristics.two_opt_restart(xy, order)
        assert sorted(many) == order and open_km(xy, many) <= open_km(xy, one) + 0.001 and many[:1] == order[:1]
        assert all(open_km(xy, o) > open_km(xy, many) - 0.001 - 1e-9 for o in reversals(many))


def test_closed_tours_by_the_change_of_two_edges():
    for seed in range(5):
        xy = np.random.default_rng(seed).uniform(-25, -20, (12, 2))
        got = heuristics.two_opt_closed(xy, list(range(12)), xy.mean(0))
        length = lambda o: tour(xy[o].tolist(), xy.mean(0).tolist())
        assert sorted(got) == list(range(12))
        assert all(length(got[:i] + got[i:j][::-1] + got[j:]) >= length(got) - 1e-6 for i, j in itertools.combinations(range(13), 2))


def test_unknown_improvement(spark):
    with pytest.raises(ValueError, match="unknown improvement"):
        routing.tours(spark.createDataFrame([], "r long, k long, lat double, lon double, a double, b double"), ["r"], "k", "lat", "lon", "a", "b", improve="best")


def test_registered_reversals(spark):
    plain, one, many = (QUERIES[q](spark, FOLDER).toPandas() for q in ("rt01_tours", "rt03_single_reversal", "rt03_restarting"))
    from campovia.plans.base import points

    at = {r.id: (r.lat, r.lon) for r in points(spark, FOLDER).collect()}
    order = lambda df: {k: g.sort_values("seq").id.tolist() for k, g in df.groupby(["state", "route"])}
    a, b, c = order(plain), order(one), order(many)
    assert a.keys() == b.keys() == c.keys()
    for k in a:
        lengths = [open_km(at, o) for o in [a[k], *reversals(a[k])]]
        assert abs(open_km(at, b[k]) - min(lengths)) < 1e-6 and sorted(c[k]) == sorted(a[k]) and open_km(at, c[k]) <= open_km(at, b[k]) + 0.001


# ---- trips -------------------------------------------------------------------------------------------------------


def round_cost(cost, order):
    return sum(cost[a][b] for a, b in zip(order, [*order[1:], order[0]]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_few_stops_are_ordered_exactly(n):
    for seed in range(3):
        cost = np.random.default_rng(seed).uniform(1, 9, (n, n))  # by direction
        best = min(round_cost(cost, (0, *rest)) for rest in itertools.permutations(range(1, n)))
        got = lines.trip_order(cost)
        assert sorted(got) == list(range(n)) and got[0] == 0 and abs(round_cost(cost, got) - best) < 1e-9


def test_many_stops_are_inserted():
    for seed in range(5):
        xy = np.random.default_rng(seed).uniform(0, 1, (9, 2))
        cost = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        got = lines.insertion_trip(cost)
        assert sorted(got) == list(range(9)) and round_cost(cost, got) <= 1.15 * round_cost(cost, lines.exact_trip(cost))
    cost = np.random.default_rng(1).uniform(1, 9, (60, 60))
    assert sorted(lines.trip_order(cost)) == list(range(60))


def legs_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long, km double, minutes double")


def test_steps_of_the_cascade(spark):
    """One line a step: answered, all legs known, some, none, of one place, of one stop; the trip takes the round 1-3-2."""
    place = lambda i: (-22.0 - i / 10, -45.0 + i / 20)
    stops = [("full", s, i, *place(i)) for s, i in enumerate((1, 2, 3))] + [("told", s, i, *place(i)) for s, i in enumerate((1, 2))]
    stops += [("some", s, i, *place(i)) for s, i in enumerate((4, 5, 6))] + [("none", s, i, *place(i)) for s, i in enumerate((7, 8))]
    stops += [("same", 0, 9, *place(9)), ("same", 1, 10, *place(9)), ("alone", 0, 11, *place(11)), ("near", 0, 12, -22.0, -45.0), ("near", 1, 13, -22.0, -45.0001)]
    own = spark.createDataFrame(stops, "line string, seq long, id long, lat double, lon double")
    minutes = {(1, 2): 9.0, (2, 3): 9.0, (3, 1): 9.0, (1, 3): 1.0, (3, 2): 1.0, (2, 1): 1.0, (4, 5): 20.0, (5, 4): 20.0}
    legs = legs_of(spark, [(a, b, m * 2, m) for (a, b), m in minutes.items()] + [(1, 3, 99.0, 99.0), (5, 6, 0.01, 5.0), (12, 13, 0.001, 0.001)])
    answers = spark.createDataFrame([("told", 7.77777, 3.33), ("full", 0.01, 3.0), (None, 5.0, 5.0)], "line string, km double, minutes double")
    got = {r.line: (r.distancia_km, r.tempo_min, r.fonte) for r in lines.line_answers(own, "line", "seq", "id", "lat", "lon", legs, 1.3, 35.0, answers).collect()}
    great = lambda i, j: km(*place(i), *place(j)) * 1.3
    assert got["told"] == (7.778, 3.3, "route") and got["full"] == (6.0, 3.0, "trip")
    assert got["some"] == (round(40 + great(5, 6), 3), round(20 + great(5, 6) / 35 * 60, 1), "segmentado")
    assert got["none"] == (round(great(7, 8), 3), round(great(7, 8) / 35 * 60, 1), "segmentado")
    assert got["same"] == got["alone"] == (0.0, 0.0, "empty")
    assert got["near"][2] == "haversine_full" and got["near"][0] < 0.05
    assert lines.line_answers(own.limit(0), "line", "seq", "id", "lat", "lon", legs, 1.3, 35.0).count() == 0


def test_long_lines_go_on_to_the_next_step(spark):
    own = spark.createDataFrame([("x", i, i, -22.0 - i / 10, -45.0) for i in range(6)], "line string, seq long, id long, lat double, lon double")
    legs = legs_of(spark, [(a, b, 5.0, 5.0) for a in range(6) for b in range(6)])
    kind = lambda most: lines.line_answers(own, "line", "seq", "id", "lat", "lon", legs, 1.3, 35.0, most=most).first()
    assert kind(6)[1:] == (30.0, 30.0, "trip") and kind(5)[1:] == (25.0, 25.0, "segmentado")


def test_registered_trips(spark):
    """Rounds of up to eight stops are the best of all orders; lines of which a leg is unknown have none."""
    from campovia.plans.administered import _lines

    stops, legs = (df.toPandas() for df in _lines(spark, FOLDER))
    cost = {(r.a, r.b): r.minutes for r in legs.itertuples()}
    got = QUERIES["rt05_trips"](spark, FOLDER).toPandas()
    seen = 0
    for line, own in stops.groupby("line"):
        ids, mine = sorted(own.id), got[got.line == line].sort_values("ordem")
        if len(ids) < 2 or any((a, b) not in cost for a, b in itertools.permutations(ids, 2)):
            assert mine.empty
            continue
        assert sorted(mine.id) == ids and mine.id.iloc[0] == ids[0]
        whole = lambda o: sum(cost[a, b] for a, b in zip(o, [*o[1:], o[0]]))
        assert abs(whole(mine.id.tolist()) - mine.minutes.iloc[0]) < 0.001
        if len(ids) <= 8:
            seen += 1
            assert mine.minutes.iloc[0] <= min(whole((ids[0], *rest)) for rest in itertools.permutations(ids[1:])) + 0.001
    assert seen > 3
    kinds = QUERIES["rt05_line_answers"](spark, FOLDER).toPandas()
    assert sorted(kinds.line) == sorted(stops.line.unique()) and {"trip", "segmentado", "route"} <= set(kinds.fonte)


# ---- matrices ----------------------------------------------------------------------------------------------------


def test_a_missing_block_falls_back_alone(spark):
    rows = [("g", i, -22.0 - i / 100, -45.0) for i in range(5)] + [("g", 9, -22.0, -45.0), ("g", 10, None, -45.0), ("h", 20, -22.0, -45.0)]
    blocks = lines.matrix_blocks(spark.createDataFrame(rows, "g string, id long, lat double, lon double"), ["g"], "id", "lat", "lon", size=2)
    assert {(r.g, r.bi, r.bj): (len(r.src), len(r.dst)) for r in blocks.collect()} == {**{("g", i, j): (2 - i // 2, 2 - j // 2) for i in range(3) for j in range(3)}, ("h", 0, 0): (1, 1)}
    two = [[1.0, 2.0], [3.0, None]]
    answers = [("g", 0, 0, "Ok", two, two), ("g", 0, 1, "NoTable", two, two), ("g", 1, 0, "Ok", [[1.0]], [[1.0]]), ("g", 1, 1, "Ok", two, None), ("g", 1, 2, "Ok", [[7.0], [8.0]], [[7.0], [8.0]]), ("h", 0, 0, None, two, two)]
    told = spark.createDataFrame(answers, "g string, bi int, bj int, code string, km array<array<double>>, minutes array<array<double>>")
    mx = lines.matrix_by_blocks(blocks, ["g"], told, 1.3, 35.0)
    got = {(r.g, r.i, r.j): (r.km, r.minutes, r.fonte) for r in mx.collect()}
    assert len(got) == 26  # the repeated place is one, the null one none
    assert {k: v for k, v in got.items() if v[2] == "table"} == {("g", 0, 0): (1.0, 1.0, "table"), ("g", 0, 1): (2.0, 2.0, "table"), ("g", 1, 0): (3.0, 3.0, "table"), ("g", 2, 4): (7.0, 7.0, "table"), ("g", 3, 4): (8.0, 8.0, "table")}
    leg = km(-22.0, -45.0, -22.04, -45.0) * 1.3
    assert got["g", 0, 4] == (round(leg, 3), round(leg / 35 * 60, 1), "haversine")
    had = spark.createDataFrame([(-22.0, -45.0, -22.01, -45.0, 0.5, 0.5)], "y1 double, x1 double, y2 double, x2 double, km double, minutes double")
    cache = lines.filled_cache(had, mx.unionByName(mx)).collect()
    assert sorted((r.y1, r.y2, r.km) for r in cache) == [(-22.03, -22.04, 8.0), (-22.02, -22.04, 7.0), (-22.01, -22.0, 3.0), (-22.0, -22.01, 0.5)]
    assert lines.matrix_by_blocks(blocks.limit(0), ["g"], told, 1.3, 35.0).count() == 0


# ---- the address cache -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cache(spark):
    return spark.createDataFrame([(1, "A", "ra", 1.0, 1.0, "google", 1), (2, "B", "rb", 1.0, 1.0, "google", 4), (5, None, "rc", 1.0, 1.0, "google", 1)], SEEN)


def told(answers):
    rows = sorted(answers.collect(), key=lambda r: r.pedido)
    return [(r.pedido, r.codigo, r.motivo, r.id) for r in rows]


def sound(cache):
    rows = cache.collect()
    for column in ("id", "chave"):
        values = [r[column] for r in rows if r[column] is not None]
        assert len(values) == len(set(values))
    return {r.id: r for r in rows}


def test_created_once(spark, cache):
    asked = [(1, "A", "new", 0.0, 0.0), (2, "N", "rb", 0.0, 0.0), (3, "X", "rx", 91.0, 0.0), (4, None, None, 0.0, 0.0), (9, "Y", "ry", 0.0, 0.0), (8, "Y", "rz", 0.0, 0.0), (7, "Z", "rz", 0.0, 0.0), (10, "W", None, 0.0, 0.0), (11, "V", None, None, 0.0)]
    after, answers = cache_admin.create(cache, spark.createDataFrame(asked, ASKED))
    assert told(answers) == [(1, 409, "chave", 1), (2, 409, "endereco", 2), (3, 422, "coordenadas", None), (4, 422, "sem_chave", None), (7, 201, None, 6), (8, 409, "endereco", None), (9, 409, "chave", None), (10, 201, None, 7), (11, 422, "coordenadas", None)]
    got = sound(after)
    assert set(got) == {1, 2, 5, 6, 7} and (got[6].chave, got[6].versao, got[6].origem) == ("Z", 1, "manual_edit")
    none = spark.createDataFrame([], ASKED)
    assert told(cache_admin.create(cache, none)[1]) == [] and cache_admin.create(cache, none)[0].count() == 3
    assert told(cache_admin.create(cache.limit(0), spark.createDataFrame(asked[4:5], ASKED))[1]) == [(9, 201, None, 1)]


def test_two_writers_of_one_version(spark, cache):
    asked = [(2, 1, 1, None, None, 5.0, 5.0), (1, 1, 1, None, None, 6.0, 6.0), (3, 2, 3, None, None, 5.0, 5.0), (4, 99, 1, None, None, 5.0, 5.0), (5, 2, 4, "A", "rq", 5.0, 5.0), (6, 5, None, None, None, 5.0, 5.0), (7, None, 1, None, None, 5.0, 5.0), (8, 5, 1, "C", "rb", 5.0, 5.0), (9, 2, 4, None, None, None, 5.0)]
    after, answers = cache_admin.update(cache, spark.createDataFrame(asked, CHANGE))
    assert told(answers) == [(1, 200, None, 1), (2, 409, "versao", 1), (3, 409, "versao", 2), (4, 404, "id", 99), (5, 409, "chave", 2), (6, 409, "versao", 5), (7, 404, "id", None), (8, 409, "endereco", 5), (9, 422, "coordenadas", 2)]
    got = sound(after)
    assert (got[1].lat, got[1].versao, got[1].origem, got[1].chave) == (6.0, 2, "manual_edit", "A") and (got[2].versao, got[2].lat) == (4, 1.0)
    again = cache_admin.update(after, spark.createDataFrame([(1, 1, 2, "A", "ra", 7.0, 7.0), (2, 5, 1, "N", "rn", 7.0, 7.0), (3, 2, 4, "N", "rm", 7.0, 7.0)], CHANGE))
    assert told(again[1]) == [(1, 200, None, 1), (2, 200, None, 5), (3, 409, "chave", 2)] and sound(again[0])[5].chave == "N"


def test_upserts_and_deletes(spark, cache):
    asked = [(1, "A", "ra", 3.0, 3.0, None), (2, "A", "ra", 4.0, 4.0, "google"), (3, "N", "rn", 5.0, 5.0, None), (4, None, "rn", 5.0, 5.0, None), (5, "M", "rm", 500.0, 5.0, None)]
    after, answers = cache_admin.upsert(cache, spark.createDataFrame(asked, ASKED + ", origem string"))
    assert told(answers) == [(1, 200, None, 1), (2, 200, None, 1), (3, 201, None, 6), (4, 422, "sem_chave", None), (5, 422, "coordenadas", None)]
    got = sound(after)
    assert (got[1].lat, got[1].versao, got[1].origem, got[6].origem) == (4.0, 2, "google", "correcao_manual") and set(got) == {1, 2, 5, 6}
    left, answers = cache_admin.delete(after, spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 2, None), (5, 77, 1), (6, None, 1)], "pedido long, id long, versao long"))
    assert told(answers) == [(1, 409, "versao", 1), (2, 204, None, 1), (3, 404, "id", 1), (4, 204, None, 2), (5, 404, "id", 77), (6, 404, "id", None)] and set(sound(left)) == {5, 6}


def test_keys_of_address_parts(spark):
    rows = spark.createDataFrame([("Rua das Flores", "10", "Campinas", "sp"), ("Rua das Flores", None, "Campinas", "sp"), (" ", "1", "Campinas", "sp"), ("Rua A", "1", None, "sp")], "logradouro string, numero string, cidade string, uf string")
    got = cache_admin.with_address(rows).collect()
    assert got[0].endereco == "RUA DAS FLORES 10, CAMPINAS - SP" and got[0].chave and got[1].chave != got[0].chave
    assert [(r.chave, r.endereco) for r in got[2:]] == [(None, None)] * 2


# ---- snapshots ---------------------------------------------------------------------------------------------------


def test_snapshots_are_listed_and_restored(spark, tmp_path):
    path, rows = str(tmp_path / "s"), lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert snapshots.listing(spark, path).count() == 0
    with pytest.raises(LookupError):
        snapshots.restore(spark, path, "t")
    one = snapshots.save({"t": rows((1, "a"), (2, None)), "u": rows((9, "z"))}, path, "x", tenant=1, tags={"uf": "SP", "cidade": "São João"})
    two = snapshots.save({"t": rows((2, "b"), (3, "c"))}, path, "y", tenant=2, tags={"uf": "RJ"})
    three = snapshots.save({"t": rows()}, path, "x", tenant=1, description="empty")
    assert [one, two, three] == [1, 2, 3]
    assert {(r.id, r.nome, r.tabelas["t"]) for r in snapshots.listing(spark, path).collect()} == {(1, "x", 2), (2, "y", 2), (3, "x", 0)}
    assert [r.id for r in snapshots.listing(spark, path, uf="SP", cidade="São João").collect()] == [1] and snapshots.listing(spark, path, tenant=1, as_of=2).count() == 1
    assert sorted(snapshots.restore(spark, path, "t", as_of=one).collect()) == [(1, "a"), (2, None)]
    assert snapshots.restore(spark, path, "t").count() == 0 and snapshots.restore(spark, path, "t", name="y").count() == 2
    assert [r.k for r in snapshots.restore(spark, path, "u").collect()] == [9]
    assert {(r.k, r.mudanca) for r in snapshots.changes(spark, path, "t", ["k"], one, two).collect()} == {(1, "removida"), (2, "alterada"), (3, "nova")}
    with pytest.raises(ValueError):
        snapshots.save({}, path, "x")


def test_writers_at_once_get_ids_of_their_own(spark, tmp_path):
    path = str(tmp_path / "s")
    save = lambda i: snapshots.save({"t": spark.createDataFrame([(i,)], "k long")}, path, f"n{i}")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(save, range(6)))
    assert sorted(ids) == [1, 2, 3, 4, 5, 6]
    assert {n: snapshots.restore(spark, path, "t", as_of=i).first().k for n, i in enumerate(ids)} == {n: n for n in range(6)}


def test_a_snapshot_without_its_entry_is_not_there(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.save({"t": spark.range(2)}, path, "x")
    spark.range(5).write.parquet(f"{path}/data/left-behind/t")
    assert snapshots.listing(spark, path).count() == 1 and snapshots.restore(spark, path, "t").count() == 2


# ---- views and districts -----------------------------------------------------------------------------------------


def test_routes_of_a_state_or_city(spark):
    routes = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, None)], "cluster_id long, subcluster_seq long, km double")
    stops = spark.createDataFrame([(1, 1, 10, 1.0, 1.0), (1, 1, 11, 3.0, 1.0), (1, 2, 99, 7.0, 1.0), (2, 1, 12, None, 1.0), (None, 1, 10, 1.0, 1.0)], "cluster_id long, subcluster_seq long, pdv_id long, lat double, lon double")
    pdvs = spark.createDataFrame([(10, "SP", "Campinas"), (11, "RJ", "Rio"), (12, "SP", None)], "id long, uf string, cidade string")
    got = lambda *a: {(r.cluster_id, r.subcluster_seq): r.centro_lat for r in reports.operational_routes(routes, stops, pdvs, *a).collect()}
    assert got() == {(1, 1): 2.0, (1, 2): 7.0, (2, 1): None}  # a point that is not known counts where nothing is asked for
    assert got("SP") == {(1, 1): 1.0, (2, 1): None} and got("SP", "CAMPINAS") == {(1, 1): 1.0} and got(None, "rio") == {(1, 1): 3.0} and got("XX") == {}


def test_districts_of_blank_cells(spark):
    rows = [(1, -22.0000001, -45.0, None), (2, -22.0, -45.0, " "), (3, -22.0, -45.0, "Centro"), (4, None, -45.0, ""), (5, 1.0, 1.0, None), (6, 2.0, 2.0, None), (7, 3.0, 3.0, "")]
    p = spark.createDataFrame(rows, "id long, lat double, lon double, bairro string")
    answers = spark.createDataFrame([(-22_000_000, -45_000_000, {"city": "C", "village": " V "}), (1_000_000, 1_000_000, {"road": "R"}), (3_000_000, 3_000_000, None)], "y long, x long, endereco map<string,string>")
    fallback = spark.createDataFrame([(1_000_000, 1_000_000, "F"), (-22_000_000, -45_000_000, "not asked"), (3_000_000, 3_000_000, " ")], "y long, x long, bairro string")
    got = {r.id: r.bairro for r in geocode.districts(p, answers, fallback).collect()}
    assert got == {1: "V", 2: "V", 3: "Centro", 4: "Não identificado", 5: "F", 6: "Não identificado", 7: "Não identificado"}
    assert geocode.districts(p.limit(0), answers, fallback).count() == 0
