"""Queries of filters, joins, aggregates, deduplication, windows, sorting, set operations and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions import geo, ids, text
from campovia.operators import dedup, filters, reports, upserts
from campovia.plans.base import ADDRESSES, POINTS, address_parts, points, query
from campovia.session import table


def t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


# ---- filters -----------------------------------------------------------------------------------------------------


@query("f01_optional_filters", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
def f01(spark, sf_dir):
    asked = {"c_nationkey": 3, "c_mktsegment": None}
    return t(spark, sf_dir, "customer").where(filters.all_of([None if v is None else F.col(k) == v for k, v in asked.items()])).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("f02_ignoring_case", "SELECT c_custkey, c_mktsegment FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
def f02(spark, sf_dir):
    return t(spark, sf_dir, "customer").where(filters.equals_ignoring_case(F.col("c_mktsegment"), "Building")).select("c_custkey", "c_mktsegment")


@query("f03_search_terms", "SELECT p_partkey, p_name FROM part WHERE coalesce(p_name, p_type) ILIKE '%a%' AND coalesce(p_name, p_type) ILIKE '%1%'")
def f03(spark, sf_dir):
    return t(spark, sf_dir, "part").where(text.contains_all(F.coalesce("p_name", "p_type"), ["A", "1"])).select("p_partkey", "p_name")


@query("f04_any_contains", "SELECT p_partkey FROM part WHERE p_name ILIKE '%12%' OR p_brand ILIKE '%12%' OR p_type ILIKE '%12%'")
def f04(spark, sf_dir):
    return t(spark, sf_dir, "part").where(filters.any_contains([F.col(c) for c in ("p_name", "p_brand", "p_type")], "12")).select("p_partkey")


@query("f05_membership", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def f05(spark, sf_dir):
    both = filters.all_of([filters.one_of(F.col("o_orderstatus"), ["F", "P"]), filters.one_of(F.col("o_orderpriority"), "1-URGENT"), filters.one_of(F.col("o_custkey"), None)])
    return t(spark, sf_dir, "orders").where(both).select("o_orderkey", "o_orderstatus")


@query("f06_situation", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def f06(spark, sf_dir):
    active = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    review = F.when(F.col("c_custkey") % 5 == 0, True)
    return t(spark, sf_dir, "customer").where(filters.situation(active, review, "ativo")).select("c_custkey")


@query("f07_date_ranges", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def f07(spark, sf_dir):
    return t(spark, sf_dir, "orders").where(filters.on_days(F.col("o_orderdate"), "1995-01-01", "1995-12-31")).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("f07_local_days", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-13 03:00:00'")
def f07_local(spark, sf_dir):
    return t(spark, sf_dir, "events").where(filters.in_local_days(F.col("ts").cast("timestamp"), "2024-01-05", "2024-01-12")).select("event_id")


@query("f08_sane_coordinates", f"WITH {POINTS} SELECT id FROM points WHERE id % 7 <> 0 AND id % 11 <> 0")
def f08(spark, sf_dir):
    lat = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 == 0, 91.0).otherwise(F.col("lat"))
    return points(spark, sf_dir).where(geo.sane(lat, F.col("lon"))).select("id")


_UF = "(['SP', 'RJ', 'MG', 'XX', 'PR'])[id % 5 + 1]"


def _with_state(spark, sf_dir):
    uf = F.element_at(F.array(*[F.lit(x) for x in ("SP", "RJ", "MG", "XX", "PR")]), (F.col("id") % 5 + 1).cast("int"))
    return points(spark, sf_dir).withColumn("uf", uf)


def _box_sql(lat="lat", lon="lon", uf="uf"):
    return "CASE " + uf + " " + " ".join(f"WHEN '{k}' THEN {lat} BETWEEN {a} AND {b} AND {lon} BETWEEN {c} AND {d}" for k, (a, b, c, d) in geo.STATE_BOXES.items() if k in ("SP", "RJ", "MG", "PR")) + " END"


@query("f09_point_status", f"WITH {POINTS}, s AS (SELECT *, {_UF} AS uf FROM points) SELECT id, CASE WHEN id % 13 = 0 THEN 'falha' WHEN coalesce({_box_sql()}, TRUE) THEN 'ok' ELSE 'fora_uf' END AS status FROM s")
def f09(spark, sf_dir):
    lat = F.when(F.col("id") % 13 != 0, F.col("lat"))
    return _with_state(spark, sf_dir).select("id", geo.point_status(lat, F.col("lon"), F.lower("uf")).alias("status"))


@query("f10_audit", f"WITH {POINTS}, s AS (SELECT *, {_UF} AS uf FROM points) SELECT id, CASE WHEN id % 13 = 0 THEN 'falha_geolocalizacao' WHEN uf = 'XX' THEN 'uf_invalida' WHEN NOT {_box_sql()} THEN 'coordenadas_fora_limites' END AS reason FROM s")
def f10(spark, sf_dir):
    lat = F.when(F.col("id") % 13 != 0, F.col("lat"))
    return _with_state(spark, sf_dir).select("id", geo.audit_reason(lat, F.col("lon"), F.col("uf")).alias("reason"))


@query("f11_unswapped", f"WITH {POINTS} SELECT id, lat, lon FROM points")
def f11(spark, sf_dir):
    p, odd = points(spark, sf_dir), F.col("id") % 2 == 1
    lat, lon = geo.unswapped(F.when(odd, F.col("lon")).otherwise(F.col("lat")), F.when(odd, F.col("lat")).otherwise(F.col("lon")))
    return p.select("id", lat.alias("lat"), lon.alias("lon"))


@query("f12_generic_points", f"""WITH {POINTS} SELECT id, id % 17 = 0 OR {geo.haversine_sql('lat', 'lon', '-22.563', '-47.401')} < 5 OR {geo.haversine_sql('lat', 'lon', '-14.235004', '-51.92528')} < 10 AS generic FROM points""")
def f12(spark, sf_dir):
    zero = F.col("id") % 17 == 0
    return points(spark, sf_dir).select("id", geo.generic(F.when(zero, 0.0).otherwise(F.col("lat")), F.when(zero, 0.00001).otherwise(F.col("lon"))).alias("generic"))


@query("f13_city_centres", "SELECT c_custkey AS id, c_custkey % 9 = 0 AS generic FROM customer")
def f13(spark, sf_dir):
    hit = F.col("c_custkey") % 9 == 0
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), geo.at_city_centre(F.when(hit, -23.5509).otherwise(-23.0), F.lit(-46.6336)).alias("generic"))


@query("f14_region_box", f"WITH {POINTS} SELECT id FROM points WHERE lat BETWEEN -25 AND -22 AND lon BETWEEN -47.5 AND -45")
def f14(spark, sf_dir):
    return points(spark, sf_dir).where(geo.box(F.col("lat"), F.col("lon"), geo.REGION_BOX)).select("id")


@query("f15_cep_valid", f"WITH {ADDRESSES} SELECT id, id % 3 = 0 AND cep <> '00000000' AS valid FROM addresses")
def f15(spark, sf_dir):
    cell = F.when(F.col("id") % 3 == 0, F.concat(F.substring("cep", 1, 5), F.lit("-"), F.substring("cep", 6, 3))).when(F.col("id") % 3 == 1, "00000000").otherwise(F.lit("1234567x"))
    return address_parts(spark, sf_dir).select("id", ids.cep_valid(cell).alias("valid"))


_FIT = "CASE uf " + " ".join(f"WHEN '{k}' THEN cep BETWEEN '{a}' AND '{b}'" for k, (a, b) in ids.CEP_BOUNDS.items()) + " ELSE FALSE END"
_STATES = "list_filter([" + ", ".join(f"CASE WHEN cep BETWEEN '{a}' AND '{b}' THEN '{k}' END" for k, (a, b) in sorted(ids.CEP_BOUNDS.items())) + "], lambda x: x IS NOT NULL)"


@query("f16_cep_fits_state", f"WITH {ADDRESSES} SELECT id, {_FIT} AS fits, array_to_string({_STATES}, ',') AS states FROM addresses")
def f16(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", ids.cep_fits_state(F.col("cep"), F.col("uf")).alias("fits"), F.array_join(ids.states_of_cep(F.col("cep")), ",").alias("states"))


_GAPS = f"WITH {ADDRESSES}, g AS (SELECT id, CASE WHEN id % 4 <> 0 THEN street END AS logradouro, CASE WHEN id % 6 <> 0 THEN city ELSE ' ' END AS cidade, uf FROM addresses)"


def _gaps(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", F.when(F.col("id") % 4 != 0, F.col("street")).alias("logradouro"), F.when(F.col("id") % 6 != 0, F.col("city")).otherwise(" ").alias("cidade"), "uf")


@query("f17_required_fields", _GAPS + " SELECT id, concat_ws('|', CASE WHEN id % 4 = 0 THEN 'campo_obrigatorio_logradouro' END, CASE WHEN id % 6 = 0 THEN 'campo_obrigatorio_cidade' END) AS motivo_invalidade FROM g WHERE id % 4 = 0 OR id % 6 = 0")
def f17(spark, sf_dir):
    return filters.split_required(_gaps(spark, sf_dir), ["logradouro", "cidade", "uf"])[1].select("id", "motivo_invalidade")


@query("f18_required_columns", _GAPS + " SELECT id FROM g")
def f18(spark, sf_dir):
    return filters.assert_columns(_gaps(spark, sf_dir), ["logradouro", "cidade", "uf"]).select("id")


@query("f19_first_bad_rows", "SELECT CAST(x AS BIGINT) AS sheet_row FROM (SELECT c_custkey + 2 AS x FROM customer WHERE c_custkey % 4 = 0 ORDER BY 1 LIMIT 10)")
def f19(spark, sf_dir):
    rows = filters.first_bad_rows(_gaps(spark, sf_dir), F.col("logradouro").isNull(), "id")
    return spark.createDataFrame([(r,) for r in rows], "sheet_row long")


@query("f20_f21_columns", "SELECT c_custkey AS cnpj, c_mktsegment AS cidade, c_nationkey AS tempo_atendimento_min FROM customer")
def f20(spark, sf_dir):
    raw = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" CNPJ "), F.col("c_mktsegment").alias("Cidáde"), F.col("c_nationkey").alias("Tempo-Servico (min)"), F.col("c_name").alias("outra"))
    return filters.known_columns(filters.canonical_columns(raw))


@query("f22_display_or_parts", f"WITH {ADDRESSES} SELECT id, CASE WHEN id % 2 = 0 THEN trim(street) ELSE concat_ws(', ', city, uf) END AS shown FROM addresses")
def f22(spark, sf_dir):
    whole = F.when(F.col("id") % 2 == 0, F.col("street")).otherwise("  ")
    return address_parts(spark, sf_dir).select("id", F.coalesce(F.nullif(F.trim(whole), F.lit("")), F.concat_ws(", ", "city", F.lit(None).cast("string"), "uf")).alias("shown"))


@query("f23_distinct_from", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END IS DISTINCT FROM 'F'")
def f23(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return t(spark, sf_dir, "orders").where(~status.eqNullSafe(F.lit("F"))).select("o_orderkey")


@query("f24_size_guard", "SELECT 'customer' AS tabela, count(*) AS n, count(*) > 3000 AS recusada FROM customer UNION ALL SELECT 'lineitem', count(*), count(*) > 3000 FROM lineitem")
def f24(spark, sf_dir):
    def judged(name):
        try:
            return filters.guard_size(t(spark, sf_dir, name), 3000).withColumn("recusada", F.lit(False))
        except ValueError:
            return t(spark, sf_dir, name).withColumn("recusada", F.lit(True))

    counts = [judged(n).groupBy("recusada").agg(F.count("*").alias("n")).select(F.lit(n).alias("tabela"), "n", "recusada") for n in ("customer", "lineitem")]
    return counts[0].union(counts[1])


# ---- joins -------------------------------------------------------------------------------------------------------


@query("j01_inner_composite", "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 45")
def j01(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").where("l_quantity > 45")
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("j02_left_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j02(spark, sf_dir):
    counts = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_FIRST = "first_orders AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)"


@query("j03_left_join_first", f"WITH {_FIRST} SELECT c_custkey, o_orderkey FROM customer LEFT JOIN first_orders ON o_custkey = c_custkey AND rn = 1")
def j03(spark, sf_dir):
    first = dedup.first_by(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("j04_normalised_text", "SELECT a.n_nationkey, b.n_regionkey FROM nation a LEFT JOIN nation b ON upper(trim(' ' || lower(a.n_name))) = upper(trim(b.n_name))")
def j04(spark, sf_dir):
    a = t(spark, sf_dir, "nation").select("n_nationkey", F.upper(F.trim(F.concat(F.lit(" "), F.lower("n_name")))).alias("k"))
    b = t(spark, sf_dir, "nation").select("n_regionkey", F.upper(F.trim("n_name")).alias("k"))
    return a.join(b, "k", "left").select("n_nationkey", "n_regionkey")


@query("j05_left_merge_coalesce", "SELECT c.c_custkey, coalesce(s.s_acctbal, c.c_acctbal) AS balance FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey")
def j05(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return t(spark, sf_dir, "customer").join(s, "c_custkey", "left").select("c_custkey", F.coalesce("s_acctbal", "c_acctbal").alias("balance"))


@query("j06_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j06(spark, sf_dir):
    urgent = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("j07_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j07(spark, sf_dir):
    done = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("j08_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j08(spark, sf_dir):
    """Small lookup tables: Spark broadcasts them by their size."""
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("j13_nearest_row_per_group", f"""WITH {POINTS}, r AS (SELECT a.state, b.id, row_number() OVER (PARTITION BY a.state ORDER BY (b.lat - a.lat) ** 2 + (b.lon - a.lon) ** 2, b.id) AS rn
FROM (SELECT state, avg(lat) AS lat, avg(lon) AS lon FROM points GROUP BY state) a JOIN points b ON a.state = b.state) SELECT state, id FROM r WHERE rn = 1""")
def j13(spark, sf_dir):
    p = points(spark, sf_dir)
    mean = p.groupBy("state").agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    d = geo.planar_sq(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))
    return p.join(mean, "state").groupBy("state").agg(F.min(F.struct(d.alias("d"), "id")).alias("best")).select("state", "best.id")


@query("j14_pair_lookup", f"WITH {POINTS} SELECT a.id, b.id AS cached FROM points a JOIN points b ON round(a.lat, 6) = round(b.lat + 1e-9, 6) AND round(a.lon, 6) = round(b.lon, 6)")
def j14(spark, sf_dir):
    p = points(spark, sf_dir)
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    a = p.select("id", micro("lat").alias("y"), micro("lon").alias("x"))
    b = p.select(F.col("id").alias("cached"), F.round((F.col("lat") + 1e-9) * 1e6).cast("long").alias("y"), micro("lon").alias("x"))
    return a.join(b, ["y", "x"]).select("id", "cached")


# ---- aggregates --------------------------------------------------------------------------------------------------


@query("a01_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY ALL")
def a01(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high")
    )


@query("a02_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def a02(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("a03_sum_distinct", "SELECT l_suppkey, sum(DISTINCT l_quantity) AS qty FROM lineitem GROUP BY l_suppkey")
def a03(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum_distinct("l_quantity").alias("qty"))


@query("a04_filtered_counts", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS kinds FROM orders GROUP BY o_custkey")
def a04(spark, sf_dir):
    status = F.col("o_orderstatus")
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.when(status == "F", 1)).alias("done"), F.countDistinct(F.when(status == "O", F.col("o_orderpriority"))).alias("kinds"))


@query("a05_rounded_average", "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY o_orderpriority")
def a05(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("price"))


@query("a06_sum_or_zero", "SELECT c_custkey, coalesce(round(sum(o_totalprice), 2), 0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def a06(spark, sf_dir):
    spent = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(spent, "c_custkey", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))


@query("a07_having_range", "SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY o_custkey HAVING max(o_orderdate) >= TIMESTAMP '1997-01-01' AND max(o_orderdate) < TIMESTAMP '1998-01-01'")
def a07(spark, sf_dir):
    g = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return g.where((F.col("m") >= "1997-01-01") & (F.col("m") < "1998-01-01")).select("o_custkey", F.to_date("m").alias("last_day"))


@query("a08_count_groups", "SELECT count(*) AS n FROM (SELECT o_custkey, o_orderstatus FROM orders GROUP BY ALL)")
def a08(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.lit(1)).agg(F.count("*").alias("n"))


@query("a09_max_text", "SELECT p_brand, max(trim(p_name)) AS name FROM part GROUP BY p_brand")
def a09(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.trim("p_name")).alias("name"))


@query("a10_dependent_columns", "SELECT s_suppkey, s_name, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name")
def a10(spark, sf_dir):
    n = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(n, "s_suppkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("a11_monthly_rollup", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS rotas, round(sum(l_quantity), 2) AS km, round(sum(l_quantity) * 4, 2) AS km_mes, round(avg(l_quantity), 2) AS km_medio FROM lineitem GROUP BY l_suppkey")
def a11(spark, sf_dir):
    km = F.sum("l_quantity")
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("rotas"), F.round(km, 2).alias("km"), F.round(km * 4, 2).alias("km_mes"), F.round(F.avg("l_quantity"), 2).alias("km_medio"))


@query("a12_weighted_centre", f"WITH {POINTS} SELECT state, round(CASE WHEN sum(id) = 0 THEN avg(lat) ELSE sum(lat * id) / sum(id) END, 6) AS lat, round(CASE WHEN sum(id) = 0 THEN avg(lon) ELSE sum(lon * id) / sum(id) END, 6) AS lon FROM points GROUP BY state")
def a12(spark, sf_dir):
    return reports.weighted_centre(points(spark, sf_dir), "state", "lat", "lon", "id").select("state", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("a13_normalised_weights", f"WITH {POINTS}, w AS (SELECT state, lat, (id + 1)::DOUBLE / max(id + 1) OVER (PARTITION BY state) AS w FROM points) SELECT state, round(sum(lat * w) / sum(w), 6) AS lat FROM w GROUP BY state")
def a13(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("w", F.col("id") + 1)
    top = p.groupBy("state").agg(F.max("w").alias("top"))
    return p.join(top, "state").groupBy("state").agg((F.sum(F.col("lat") * F.col("w") / F.col("top")) / F.sum(F.col("w") / F.col("top"))).alias("lat")).select("state", F.round("lat", 6).alias("lat"))


@query("a14_sorted_percentiles", "WITH s AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS d FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, d[len(d) // 2 + 1] AS median, CASE WHEN len(d) < 2 THEN d[1] ELSE d[CAST(floor(0.95 * len(d)) AS INTEGER)] END AS p95 FROM s")
def a14(spark, sf_dir):
    return reports.ranked_values(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", median=reports.median_rank, p95=reports.p95_rank)


@query("a15_nearest_rank_p95", "WITH s AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS d FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, d[CAST(round_even(0.95 * (len(d) - 1), 0) AS INTEGER) + 1] AS p95 FROM s")
def a15(spark, sf_dir):
    return reports.ranked_values(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", p95=reports.nearest_p95_rank)


@query("a16_threshold", "SELECT o_orderpriority, round(avg(o_totalprice) + 1.5 * stddev_pop(o_totalprice), 4) AS bar FROM orders GROUP BY o_orderpriority")
def a16(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice") + 1.5 * F.stddev_pop("o_totalprice"), 4).alias("bar"))


@query("a17_value_counts", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a17(spark, sf_dir):
    return reports.value_counts(t(spark, sf_dir, "orders"), "o_orderstatus")


@query("a18_largest_group", "SELECT c_nationkey AS value, n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, value LIMIT 1")
def a18(spark, sf_dir):
    return reports.value_counts(t(spark, sf_dir, "customer"), "c_nationkey").orderBy(F.desc("n"), "value").limit(1)


@query("a19_success_rate", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS cache_hits, round(100.0 * count(*) FILTER (WHERE event_type <> 'view')::DOUBLE / count(*), 2) AS rate FROM events")
def a19(spark, sf_dir):
    kind = F.col("event_type")
    return t(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count(F.when(kind == "click", 1)).alias("cache_hits"), F.round(100 * F.count(F.when(kind != "view", 1)) / F.count("*"), 2).alias("rate"))


@query("a20_nested_itinerary", """WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, string_agg(CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_orderkey, l_linenumber) AS visits FROM lineitem GROUP BY ALL)
SELECT l_suppkey, string_agg(CAST(day AS VARCHAR) || ': ' || visits, '; ' ORDER BY day) AS itinerary FROM d GROUP BY l_suppkey""")
def a20(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), F.struct("l_orderkey", "l_linenumber").alias("v"))
    show = lambda v: F.concat_ws(".", v["l_orderkey"].cast("string"), v["l_linenumber"].cast("string"))
    days = li.groupBy("l_suppkey", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), show), " ").alias("visits"))
    whole = days.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("day", "visits"))).alias("days"))
    return whole.select("l_suppkey", F.array_join(F.transform("days", lambda d: F.concat_ws(": ", d["day"].cast("string"), d["visits"])), "; ").alias("itinerary"))


@query("a21_ratios", "SELECT l_suppkey, round(sum(l_quantity) / count(DISTINCT l_orderkey), 2) AS km_rota, round(sum(l_extendedprice) / count(*), 2) AS min_pdv, round(count(*) / 20, 2) AS per_day FROM lineitem GROUP BY l_suppkey")
def a21(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("km"), F.sum("l_extendedprice").alias("m"), F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("r"))
    c = F.col
    return g.select("l_suppkey", reports.ratio(c("km"), c("r")).alias("km_rota"), reports.ratio(c("m"), c("n")).alias("min_pdv"), F.round(c("n") / 20, 2).alias("per_day"))


@query("a22_cluster_summary_view", """WITH a AS (SELECT o_custkey, count(*) AS rotas, round(sum(o_totalprice), 2) AS km_total, round(avg(o_orderkey % 97), 2) AS tempo_medio FROM orders GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS pdvs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_custkey, rotas, km_total, tempo_medio, coalesce(pdvs, 0) AS pdvs FROM a LEFT JOIN b USING (o_custkey)""")
def a22(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    stops = t(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = o.withColumn("minutes", F.col("o_orderkey") % 97)
    return reports.two_level_summary(parts, stops, "o_custkey", "o_totalprice", "minutes")


# ---- deduplication -----------------------------------------------------------------------------------------------


@query("d01_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def d01(spark, sf_dir):
    return dedup.first_by(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("d02_reject_repeated", "SELECT o_orderkey, 'cnpj_duplicado_arquivo' AS motivo_invalidade FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def d02(spark, sf_dir):
    return dedup.split_repeated(t(spark, sf_dir, "orders"), ["o_custkey"])[1].select("o_orderkey", "motivo_invalidade")


@query("d03_invalid_once", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F') WHERE rn = 1")
def d03(spark, sf_dir):
    return dedup.first_by(t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("d04_last_wins", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def d04(spark, sf_dir):
    return dedup.last_by(t(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("d05_priority", """WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS lat, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 50 END AS pri FROM events)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (lat IS NOT NULL) DESC, pri, event_id) AS rn FROM r) WHERE rn = 1""")
def d05(spark, sf_dir):
    source = F.when(F.col("event_type") == "click", "cache").when(F.col("event_type") == "view", "google").otherwise("other")
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("lat"), F.lit(1.0).alias("lon"), source.alias("source"))
    return dedup.best_result(rows, "user_id", "lat", "lon", "source", ["event_id"]).select("user_id", "event_id")


# ---- windows and sorting -----------------------------------------------------------------------------------------


@query("w01_dominant", "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM c) WHERE rn = 1")
def w01(spark, sf_dir):
    return reports.dominant(t(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment"])


@query("w02_latest", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def w02(spark, sf_dir):
    return reports.latest(t(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("w03_any_by_order", "SELECT DISTINCT ON (l_suppkey) l_suppkey, l_partkey, l_orderkey FROM lineitem ORDER BY l_suppkey, l_partkey, l_orderkey")
def w03(spark, sf_dir):
    return reports.latest(t(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.col("l_partkey"), F.col("l_orderkey")]).select("l_suppkey", "l_partkey", "l_orderkey")


@query("w04_total_with_page", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def w04(spark, sf_dir):
    return reports.page(t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40).select("o_orderkey", "total")


@query("w05_position_chunks", "SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) // 25 AS chunk, c_custkey FROM customer")
def w05(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")) - 1
    return t(spark, sf_dir, "customer").select("c_nationkey", F.floor(pos / 25).cast("long").alias("chunk"), "c_custkey")


@query("w06_sequence", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER w AS INTEGER) AS seq, 'R' || dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS rota FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def w06(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rota = F.concat(F.lit("R"), F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey")))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seq.alias("seq"), rota.alias("rota"))


@query("w07_isolated", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) WHERE l_quantity > 1.9 * m")
def w07(spark, sf_dir):
    return reports.isolated(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 1.9).where("isolado").select("l_orderkey", "l_linenumber", "l_partkey")


@query("w08_compact_labels", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS INTEGER) AS label FROM customer WHERE c_nationkey % 3 = 1")
def w08(spark, sf_dir):
    return reports.compact_labels(t(spark, sf_dir, "customer").where("c_nationkey % 3 = 1"), "c_nationkey", "label").select("c_custkey", "label")


@query("s01_paging", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def s01(spark, sf_dir):
    return t(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(100).limit(50).select("c_custkey", "c_acctbal")


@query("s02_listed_order", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey DESC LIMIT 30")
def s02(spark, sf_dir):
    allowed = {"size": F.col("p_size").asc(), "name": F.col("p_name").asc()}
    return t(spark, sf_dir, "part").orderBy(allowed["size"], F.desc("p_partkey")).limit(30).select("p_partkey", "p_size")


@query("s03_sample")
def s03(spark, sf_dir):
    """A seeded sample of 100 rows: the sampling is the feature."""
    return t(spark, sf_dir, "customer").orderBy(F.rand(42)).limit(100).select("c_custkey")


@query("s04_newest", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def s04(spark, sf_dir):
    return t(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id")


@query("s06_natural_order", "WITH r AS (SELECT c_custkey, 'R' || c_custkey % 30 AS rota FROM customer) SELECT c_custkey, rota, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(rota, '(\\d+)', 1) AS INTEGER), c_custkey) AS INTEGER) AS pos FROM r ORDER BY pos")
def s06(spark, sf_dir):
    """Every row's place: rows before its number, counted by number, and its place within its number."""
    r = t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("R"), (F.col("c_custkey") % 30).cast("string")).alias("rota"))
    r = r.withColumn("nth", reports.natural_number(F.col("rota")))
    before = F.sum("n").over(Window.orderBy("nth")) - F.col("n")
    offsets = r.groupBy("nth").agg(F.count("*").alias("n")).select("nth", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("nth").orderBy("c_custkey"))
    return r.join(offsets, "nth").select("c_custkey", "rota", (F.col("before") + own).cast("int").alias("pos")).orderBy("pos")


# ---- set operations ----------------------------------------------------------------------------------------------


@query("set_union_by_name", "SELECT c_custkey AS id, c_name AS name, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("set_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_difference(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(t(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_nationkey"))


@query("set_append_missing", "SELECT s_suppkey AS id FROM supplier UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def set_append(spark, sf_dir):
    return dedup.append_missing(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


# ---- table changes -----------------------------------------------------------------------------------------------


def _cache(spark, sf_dir):
    """A cache of suppliers and later results of customers under overlapping keys."""
    old = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.when(F.col("s_suppkey") % 3 == 0, "manual_edit").otherwise("google").alias("origem"), F.lit(1).alias("version"))
    new = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("pipeline").alias("origem"), F.lit(2).alias("version"))
    return old, new


_OLD = "old AS (SELECT s_suppkey AS k, s_acctbal AS v, CASE WHEN s_suppkey % 3 = 0 THEN 'manual_edit' ELSE 'google' END AS origem FROM supplier), new AS (SELECT c_custkey AS k, c_acctbal AS v, 'pipeline' AS origem FROM customer WHERE c_custkey % 2 = 0)"


@query("snk08_insert_new", f"WITH {_OLD} SELECT k, v, origem FROM old UNION ALL SELECT k, v, origem FROM new WHERE k NOT IN (SELECT k FROM old)")
def snk08(spark, sf_dir):
    old, new = _cache(spark, sf_dir)
    return upserts.insert_new(old, new, ["k"], [F.col("v")]).select("k", "v", "origem")


@query("snk09_upsert", f"WITH {_OLD} SELECT k, coalesce(n.v, o.v) AS v, coalesce(n.origem, o.origem) AS origem FROM old o FULL JOIN new n USING (k)")
def snk09(spark, sf_dir):
    old, new = _cache(spark, sf_dir)
    return upserts.upsert(old, new, ["k"], "version").select("k", "v", "origem")


@query("snk10_guarded_upsert", f"WITH {_OLD} SELECT k, CASE WHEN n.k IS NULL OR o.origem = 'manual_edit' THEN o.v ELSE n.v END AS v, CASE WHEN n.k IS NULL OR o.origem = 'manual_edit' THEN o.origem ELSE n.origem END AS origem FROM old o FULL JOIN new n USING (k)")
def snk10(spark, sf_dir):
    old, new = _cache(spark, sf_dir)
    return upserts.guarded_upsert(old, new, "k", ["v"], "origem").select("k", "v", "origem")


@query("snk11_insert_select", "SELECT o_custkey, o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def snk11(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return o.join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "l_partkey")


@query("snk12_update_from", "SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END, s_nationkey) AS assigned FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def snk12(spark, sf_dir):
    target = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("assigned"))
    return upserts.update_from(target, t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("assigned")), ["k"], "assigned")


@query("snk13_fail_pending", "SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'geo_fail' WHEN event_type = 'view' THEN 'pending' ELSE event_type END AS status FROM events")
def snk13(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, 1.0).alias("lat"), F.lit(1.0).alias("lon"), F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")).alias("status"))
    return upserts.fail_pending(e, "lat", "lon", "status").select("event_id", "status")


@query("snk14_cascade", "SELECT 'customer' AS tab, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def snk14(spark, sf_dir):
    tables = {n: t(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    doomed = tables["customer"].where("c_nationkey = 3").select("c_custkey")
    left = upserts.cascade(tables, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")], "customer", doomed, "c_custkey")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tab"), "n") for n, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("snk15_soft_delete", "SELECT c_custkey, c_custkey % 10 <> 3 AS ativo FROM customer")
def snk15(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.lit(True).alias("ativo"))
    return upserts.set_active(c, F.col("c_custkey") % 10 == 3)
