"""The dispatch by names, the operational rounds and the functions in SQL text, against plain Python."""

import math

import numpy as np
import pytest

from campovia.operators import dispatch
from campovia.operators import heuristics as h
from campovia.plans import catalogue
from campovia.plans.base import points
from campovia.plans.dispatched import OPERATIONAL

FOLDER = "/root/testdata/sf0.01"
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def groups(spark):
    """Each state's ids and coordinates, in order of ids."""
    table = points(spark, FOLDER).select("state", "id", "lat", "lon").toPandas().sort_values("id")
    return {int(g): (own.id.tolist(), own[["lat", "lon"]].to_numpy(float)) for g, own in table.groupby("state")}


def labels_of(frame, group="state"):
    return {(str(g), int(i)): int(x) for g, i, x in zip(frame[group], frame.id, frame.label)}


def same_parts(one, other):
    """Equal partitions: labels may be named otherwise."""
    pairs = {(a, b) for a, b in zip(one, other)}
    return len(pairs) == len(set(one)) == len(set(other))


def test_settings_by_name():
    s = dispatch.settings({"algo": "Sweep ", "n_clusters": 4, "unknown": 1})
    assert (s.algoritmo, s.k_forcado, s.max_pdv_cluster) == ("capacitated_sweep", 4, 250_000_000)
    assert len(dispatch.as_dict(s)) == 22 and dispatch.settings(dispatch.as_dict(s)) == s
    for bad in ({"algo": "x"}, {"modo_refinamento": "x"}, {"algo": "consultor_nearest"}, {"modo_refinamento": "fixo"}, *({name: 0} for name in dispatch.POSITIVE)):
        with pytest.raises(ValueError):
            dispatch.settings(bad)


def test_operational_rounds(spark, groups):
    """Groups leave as soon as all their days hold; each has what refining it alone gives, and SQL text gives the same."""
    s = dispatch.settings(OPERATIONAL)
    df = points(spark, FOLDER)
    starts = {g: int(h.balanced(xy, s.max_pdv_cluster, False, math.ceil(len(xy) / s.max_pdv_cluster)).max()) + 1 for g, (_, xy) in groups.items()}
    found, routes = dispatch.operational(df, "state", "id", "lat", "lon", spark.createDataFrame(list(starts.items()), "state long, k int"), s)
    found, routes = found.toPandas(), routes.toPandas()
    assert sorted(found.id) == sorted(i for ids, _ in groups.values() for i in ids)
    assert found.rounds.nunique() > 1 and found.groupby("state").rounds.nunique().max() == 1
    told = labels_of(found)
    for g, (ids, xy) in groups.items():
        labels, days = h.refine(xy, starts[g], s.dias_uteis, s.freq, s.workday_min, s.route_km_max, s.v_kmh, s.service_min, s.alpha_path, s.max_iter)
        assert [told[str(g), i] for i in ids] == labels.tolist()
        own = routes[routes.state == g].sort_values(["label", "day"])
        assert own[["label", "day", "points", "km", "minutes", "ok"]].values.tolist() == [[d["cluster"], d["day"], d["points"], d["km"], d["minutes"], d["ok"]] for d in days]
        rounds = int(found[found.state == g].rounds.iloc[0])
        assert own.ok.all() or rounds == s.max_iter
    whole = labels_of(QUERIES["cl16_cl27_dispatch_operational"](spark, FOLDER).toPandas())
    text = labels_of(QUERIES["udf_operational_sql"](spark, FOLDER).toPandas(), "grupo")
    for g, (ids, _) in groups.items():
        assert same_parts([whole[str(g), i] for i in ids], [told[str(g), i] for i in ids])
        assert [text[str(g), i] for i in ids] == [whole[str(g), i] for i in ids]


def test_fixed_and_capacity_modes(spark, groups):
    fixed = QUERIES["cl27_dispatch_fixed"](spark, FOLDER).toPandas()
    told = labels_of(fixed)
    for g, (ids, xy) in groups.items():
        assert same_parts([told[str(g), i] for i in ids], h.kmeans(xy, 3)[0].tolist())
    sizes = fixed.groupby(["state", "label"]).size()
    assert all((status == "FORA_DA_BANDA") == (sizes[g, x] > 30) for g, x, status in zip(fixed.state, fixed.label, fixed.banda_status))
    capacity = QUERIES["cl27_dispatch_capacity"](spark, FOLDER).toPandas()
    sizes = capacity.groupby(["state", "label"]).size()
    assert sizes.max() <= 30 and all((status == "ABAIXO_MIN") == (sizes[g, x] < 10) for g, x, status in zip(capacity.state, capacity.label, capacity.banda_status))
    assert set(capacity.id) <= {i for ids, _ in groups.values() for i in ids} and (capacity.consultor == "Consultor " + (capacity.label + 1).astype(str)).all()


def test_nearest_consultants(spark, groups):
    got = QUERIES["cl12_cl27_dispatch_nearest"](spark, FOLDER).toPandas()
    where = np.array([(-24.0 + i % 3 * 2, -51.0 + i % 4 * 2) for i in range(12)])
    told = {(g, i): (c, b) for g, i, c, b in zip(got.state, got.id, got.consultor, got.banda_status)}
    for g, (ids, xy) in groups.items():
        free = [2] * 12
        for i, d in zip(ids, h.km_matrix(xy, where)):
            order = sorted(range(12), key=lambda j: (d[j], j))  # noqa: B023
            open_ = [j for j in order if free[j]]
            own = (open_ or order)[0]
            free[own] -= bool(open_)
            assert told[g, i] == (f"C{own}", "OK" if open_ else "EXCEDENTE")


def test_tours_in_sql(spark, groups):
    got = QUERIES["udf_tours_sql"](spark, FOLDER).toPandas()
    assert sorted(got.id) == sorted(i for ids, _ in groups.values() for i in ids)
    at = {i: p for ids, xy in groups.values() for i, p in zip(ids, xy)}
    for _, own in got.groupby("grupo"):
        own = own.sort_values("ordem")
        xy = np.array([at[i] for i in own.id])
        assert own.ordem.tolist() == list(range(1, len(own) + 1)) and own.km.nunique() == 1
        stops = np.vstack([xy.mean(axis=0), xy, xy.mean(axis=0)])
        km = 1.4 * sum(h.km_matrix(a[None], b[None])[0, 0] for a, b in zip(stops, stops[1:]))
        assert abs(km - own.km.iloc[0]) < 0.02 and abs(km / 40 * 60 + 30 * len(own) - own.minutos.iloc[0]) < 0.1


def test_edges(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, None, 1.0), (2, 3, float("nan"), 0.0)], "g int, id long, Latitude double, lng double")
    for algo in ("kmeans", "sweep", "dense_subset"):
        got = sorted((r.id, r.label, r.banda_status) for r in dispatch.run(df, "g", "id", {"algo": algo}).collect())
        assert [(1, 0, "OK")] == got[:1] and {x[2] for x in got[1:]} == {"SEM_COORDENADAS"} and len(got) == 3
    assert dispatch.run(df.limit(0), "g", "id", OPERATIONAL).count() == 0
    with pytest.raises(ValueError, match="more than 2"):
        dispatch.run(df, "g", "id", limit=2)
    with pytest.raises(ValueError, match="coordinates"):
        dispatch.run(df.select("g", "id"), "g", "id")
