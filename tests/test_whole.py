"""Queries take whole tables: at sf0.01 nothing is left out by an id."""

import math

import pytest
from oracle import connect, rows

from campovia.operators import nearest
from campovia.plans import base, catalogue

FOLDER = "/root/testdata/sf0.01"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def same(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert rows(ours) == rows(theirs)
    return ours


@pytest.mark.parametrize("name", ["rt03_two_opt", "rt12_time_windows"])
def test_every_point_is_on_a_route(spark, duck, name):
    got = sorted(r.id for r in QUERIES[name](spark, FOLDER).select("id").collect())
    assert got == [x for (x,) in duck.execute("SELECT c_custkey FROM customer ORDER BY 1").fetchall()]


def test_matrices_of_every_route(spark, duck):
    got = same(spark, duck, "rt06_distance_matrix")
    assert got.i.nunique() == duck.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_every_route_gets_a_day(spark, duck):
    got = same(spark, duck, "w09_ag01_schedule")
    assert got.n.sum() == duck.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_every_sellers_reports(spark, duck):
    sellers = duck.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem").fetchone()[0]
    assert same(spark, duck, "a20_nested_itinerary").l_suppkey.nunique() == sellers
    assert same(spark, duck, "rpt_routes_by_seller").l_suppkey.nunique() == sellers
    assert len(same(spark, duck, "rpt_points_by_seller")) == duck.execute("SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey").fetchone()[0]


@pytest.mark.parametrize("block", [2000, 30])
def test_every_centre_is_searched(spark, duck, monkeypatch, block):
    """In one tree and, with more centres than it takes, in shards."""
    monkeypatch.setattr(nearest, "CENTRES_AT_ONCE", block)
    assert same(spark, duck, "j09_nearest_centre").cid.max() > 20
    assert same(spark, duck, "j10_within_km").cid.max() > 20
    assert same(spark, duck, "report_sector_summary").n_pdvs.sum() == duck.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_every_row_has_a_place(spark, duck):
    got = same(spark, duck, "s06_natural_order")
    assert sorted(got.pos) == list(range(1, duck.execute("SELECT count(*) FROM customer").fetchone()[0] + 1))


def test_points_at_the_edges(spark):
    """Inside the square and out of its hole, or at most 0.005 degrees from an edge of either, by brute force."""
    places = [r for r in base.points(spark, "/root/testdata/sf0.1").select("id", "lat", "lon", "city").collect()]
    got = {r.id: r.dentro for r in QUERIES["j12_geo07_geo08_point_in_polygon"](spark, "/root/testdata/sf0.1").collect()}
    assert set(got) == {p.id for p in places}
    boxes = [(-51.0, -24.0, -47.0, -20.0), (-49.0, -22.5, -48.0, -21.5)]
    hard = 0
    for p in places:
        if p.city == "BUILDING":
            assert got[p.id] is None
            continue
        inside = [w < p.lon < e and s < p.lat < n for w, s, e, n in boxes]
        off = lambda x, a, b: max(a - x, 0.0, x - b)
        away = min(d for w, s, e, n in boxes for d in [*(math.hypot(p.lon - x, off(p.lat, s, n)) for x in (w, e)), *(math.hypot(p.lat - y, off(p.lon, w, e)) for y in (s, n))])
        if abs(away - 0.005) > 1e-9:  # at the bound itself rounding decides
            assert got[p.id] == (inside[0] and not inside[1] or away <= 0.005), p
            hard += away <= 0.005
    assert hard > 40
