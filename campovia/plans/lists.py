"""Queries of reports and lists: summaries, details, histories and dependency counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from campovia.functions import geo
from campovia.operators import filters, reports, territory
from campovia.plans.base import CENTRES_SQL, POINTS, points, query
from campovia.plans.domain import NEAREST, nearest
from campovia.session import table


@query("rpt_cluster_summary", f"""WITH {POINTS}, {CENTRES_SQL}, {NEAREST}, g AS (SELECT cid, count(*) AS n_pdvs, avg(lat) AS clat, avg(lon) AS clon FROM nearest GROUP BY cid), d AS (SELECT g.cid, list_sort(list({geo.haversine_sql('g.clat', 'g.clon', 'n.lat', 'n.lon')})) AS d FROM nearest n JOIN g USING (cid) GROUP BY g.cid)
SELECT cid, n_pdvs, round(clat, 10) AS centro_lat, round(clon, 10) AS centro_lon, round(d[n_pdvs // 2 + 1], 4) AS raio_med_km, round(CASE WHEN n_pdvs < 2 THEN d[1] ELSE d[CAST(floor(0.95 * n_pdvs) AS INTEGER)] END, 4) AS raio_p95_km FROM g JOIN d USING (cid)""")
def cluster_summary(spark, sf_dir):
    s = territory.sector_summary(nearest(spark, sf_dir).select("cid", "lat", "lon"), ["cid"], "lat", "lon")
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select("cid", "n_pdvs", r("centro_lat", 10), r("centro_lon", 10), r("raio_med_km", 4), r("raio_p95_km", 4))


@query("rpt_point_detail_isolated", f"WITH {POINTS}, {CENTRES_SQL}, {NEAREST} SELECT id, cid, round(km, 6) AS km, km > 1.8 * avg(km) OVER (PARTITION BY cid) AS isolado FROM nearest")
def point_detail(spark, sf_dir):
    return reports.isolated(nearest(spark, sf_dir), "cid", "distancia_km", 1.8).select("id", "cid", F.round("distancia_km", 6).alias("km"), "isolado")


@query("rpt_postcode_summary", f"""WITH {POINTS}, {CENTRES_SQL}, {NEAREST} SELECT cid, count(DISTINCT id // 7) AS ceps, round(sum(sales), 2) AS clientes, round(avg(km), 4) AS dist_media, round(max(km), 4) AS dist_max, round(avg(km / 35 * 60), 4) AS tempo_medio FROM nearest GROUP BY cid HAVING count(*) > 10 ORDER BY cid""")
def postcode_summary(spark, sf_dir):
    g = nearest(spark, sf_dir).groupBy("cid").agg(
        F.countDistinct(F.floor(F.col("id") / 7)).alias("ceps"), F.round(F.sum("sales"), 2).alias("clientes"), F.round(F.avg("distancia_km"), 4).alias("dist_media"),
        F.round(F.max("distancia_km"), 4).alias("dist_max"), F.round(F.avg(F.col("distancia_km") / 35 * 60), 4).alias("tempo_medio"), F.count("*").alias("n"),
    )
    return g.where("n > 10").drop("n").orderBy("cid")


@query("rpt_routes_by_seller", "SELECT DISTINCT ON (l_suppkey, l_orderkey) l_suppkey, l_orderkey, p_brand AS cidade, p_type AS uf FROM lineitem JOIN part ON p_partkey = l_partkey ORDER BY l_suppkey, l_orderkey, p_brand, p_type")
def routes_by_seller(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cidade"), F.col("p_type").alias("uf"))
    g = li.join(p, "l_partkey").groupBy("l_suppkey", "l_orderkey").agg(F.min(F.struct("cidade", "uf")).alias("b"))
    return g.select("l_suppkey", "l_orderkey", "b.cidade", "b.uf")


@query("rpt_points_by_seller", "SELECT o_custkey AS vendedor, l_orderkey, l_linenumber, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def points_by_seller(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("vendedor"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").join(p, "l_partkey", "left").select("vendedor", "l_orderkey", "l_linenumber", "p_name")


@query("rpt_points_by_route_cluster", f"WITH {POINTS} SELECT state, id // 100 AS rota, count(*) AS pdvs, min(id) AS primeiro FROM points GROUP BY ALL")
def points_by_route(spark, sf_dir):
    return points(spark, sf_dir).groupBy("state", F.floor(F.col("id") / 100).alias("rota")).agg(F.count("*").alias("pdvs"), F.min("id").alias("primeiro"))


@query("api_job_list", "SELECT user_id, event_id, event_type AS status, json_extract_string(props, '$.k') AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'click'")
def job_list(spark, sf_dir):
    last = reports.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.where("event_type <> 'click'").select("user_id", "event_id", F.col("event_type").alias("status"), F.get_json_object("props", "$.k").alias("k"))


@query("api_history_page", "SELECT o_orderkey, o_custkey, count(*) OVER () AS total FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def history_page(spark, sf_dir):
    hit = filters.all_of([filters.on_days(F.col("o_orderdate"), "1996-01-01", None), filters.any_contains([F.col("o_orderpriority")], "urgent"), filters.one_of(F.col("o_orderstatus"), None)])
    return reports.page(table(spark, sf_dir, "orders").where(hit), [F.desc("o_orderdate"), F.col("o_orderkey")], 50).select("o_orderkey", "o_custkey", "total")


@query("api_points_with_dominant_city", f"WITH {POINTS}, c AS (SELECT state, city, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, city) AS rn FROM points GROUP BY state, city) SELECT p.state, count(*) AS n, round(coalesce(sum(sales), 0), 2) AS vendas, any_value(c.city) AS cidade FROM points p LEFT JOIN c ON c.state = p.state AND rn = 1 GROUP BY p.state")
def points_with_city(spark, sf_dir):
    p = points(spark, sf_dir)
    g = p.groupBy("state").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("sales"), F.lit(0.0)), 2).alias("vendas"))
    return g.join(reports.dominant(p, "state", ["city"]).select("state", F.col("city").alias("cidade")), "state", "left")


@query("api_dependency_counts", "SELECT c_custkey, count(DISTINCT o_orderkey) AS runs, count(l_orderkey) AS rotas, count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') AS abertas FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def dependency_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linestatus")
    g = o.join(li, "o_orderkey", "left").groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("runs"), F.count("l_suppkey").alias("rotas"), F.countDistinct(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("abertas"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf_dir, "customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", zero("runs"), zero("rotas"), zero("abertas"))


@query("api_defaults", "SELECT unnest(['alpha', 'day_km', 'day_minutes', 'days', 'freq', 'kmh', 'rounds', 'service', 'z']) AS name, unnest([1.4, 200, 600, 20, 1, 35, 10, 30, 3])::DOUBLE AS value")
def defaults(spark, sf_dir):
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(territory.DEFAULTS.items())], "name string, value double")
