"""Queries of the dispatch by names and of the functions in SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from campovia.functions import geo
from campovia.operators import dispatch, sql
from campovia.plans.base import CENTRES_SQL, POINTS, points, query
from campovia.plans.domain import _MEANS, _bearing_sql

_KM = geo.haversine_sql("lat", "lon", "clat", "clon")
#: What the operational run may take, so that some states hold at once and others need more clusters.
OPERATIONAL = {"algo": "kmeans", "modo_refinamento": "operacional", "max_pdv_cluster": 60, "dias_uteis": 5, "workday_min": 700, "route_km_max": 700, "v_kmh": 60, "service_min": 10, "max_iter": 4}
#: The points as a table of SQL text; the folder's path comes in front.
SQL_POINTS = """SELECT CAST(c_nationkey AS STRING) AS grupo, c_custkey AS id, -25D + CAST((c_custkey * 7919) % 60000 AS DOUBLE) / 10000D AS lat,
  -53D + CAST((c_custkey * 104729) % 80000 AS DOUBLE) / 10000D AS lon, c_name FROM parquet.`{sf_dir}/customer.parquet`"""


def in_sql(spark, sf_dir: str, text: str):
    """A query that is SQL text alone, once the functions are registered; points stands for the points' table."""
    sql.register(spark)
    return spark.sql(text.replace("{points}", f"({SQL_POINTS.replace('{sf_dir}', sf_dir)})"))


# A state is a run here and grows with the table; no row of it is refused, so the guard of the public run is lifted by its own argument.


@query("cl27_dispatch_sweep", f"WITH {POINTS}, {_MEANS} SELECT state, id, (row_number() OVER (PARTITION BY p.state ORDER BY {_bearing_sql()}, {_KM}, id) - 1) // 15 AS label, 'Equipe ' || ((row_number() OVER (PARTITION BY p.state ORDER BY {_bearing_sql()}, {_KM}, id) - 1) // 15 + 1) AS consultor, 'OK' AS banda_status FROM points p JOIN m USING (state)")
def dispatch_sweep(spark, sf_dir):
    return dispatch.run(points(spark, sf_dir), "state", "id", {"algo": "sweep", "max_pdv_cluster": 15, "consultor_prefix": "Equipe"}, limit=None)


@query("cl27_dispatch_fixed")
def dispatch_fixed(spark, sf_dir):
    return dispatch.run(points(spark, sf_dir), "state", "id", {"modo_refinamento": "fixo", "k_forcado": 3, "max_pdv_cluster": 30}, limit=None)


@query("cl27_dispatch_capacity")
def dispatch_capacity(spark, sf_dir):
    return dispatch.run(points(spark, sf_dir), "state", "id", {"modo_refinamento": "capacidade", "max_pdv_cluster": 30, "min_pdv_cluster": 10, "excluir_outliers": True, "z_thresh": 3.0}, limit=None)


@query("cl16_cl27_dispatch_operational")
def dispatch_operational(spark, sf_dir):
    return dispatch.run(points(spark, sf_dir), "state", "id", OPERATIONAL, limit=None)


@query("cl12_cl27_dispatch_nearest")
def dispatch_nearest(spark, sf_dir):
    staff = [{"nome": f"C{i}", "lat": -24.0 + i % 3 * 2, "lon": -51.0 + i % 4 * 2} for i in range(12)]
    return dispatch.run(points(spark, sf_dir), "state", "id", {"algo": "consultor_nearest", "consultores": staff, "max_pdv_cluster": 2}, limit=None)


@query("udf_scalars_sql", f"""WITH {POINTS}, {CENTRES_SQL} SELECT id, round({geo.haversine_sql('lat', 'lon', '-23.5::DOUBLE', '-46.6::DOUBLE')}, 6) AS km,
round({geo.haversine_sql('lat', 'lon', '-23.5::DOUBLE', '-46.6::DOUBLE')} / 40 * 60 + 3 * 10, 4) AS minutos, TRUE AS valida, regexp_replace(c_name, '[^0-9]', '', 'g') AS fone, c_name AS nome
FROM points JOIN customer ON c_custkey = id""")
def scalars(spark, sf_dir):
    return in_sql(spark, sf_dir, """SELECT id, round(haversine_km(lat, lon, -23.5D, -46.6D), 6) AS km, round(travel_minutes(haversine_km(lat, lon, -23.5D, -46.6D), 40D, 3, 10D), 4) AS minutos,
coordinate_sane(lat, lon) AS valida, only_digits(c_name) AS fone, ascii_only(c_name) AS nome FROM {points}""")


@query("udf_territories_sql", f"WITH {POINTS}, {_MEANS} SELECT CAST(state AS VARCHAR) AS grupo, id, (row_number() OVER (PARTITION BY p.state ORDER BY {_bearing_sql()}, {_KM}, id) - 1) // 15 AS label FROM points p JOIN m USING (state)")
def territories(spark, sf_dir):
    return in_sql(spark, sf_dir, """SELECT grupo, id, label FROM territories(TABLE(SELECT * FROM {points}) PARTITION BY (grupo) ORDER BY (id), '{"algoritmo": "capacitated_sweep", "max_pdv_cluster": 15}')""")


@query("udf_operational_sql")
def territories_operational(spark, sf_dir):
    import json

    return in_sql(spark, sf_dir, f"SELECT grupo, id, label, consultor, banda_status FROM territories(TABLE(SELECT * FROM {{points}}) PARTITION BY (grupo) ORDER BY (id), '{json.dumps(OPERATIONAL)}')")


@query("udf_tours_sql")
def tours(spark, sf_dir):
    return in_sql(spark, sf_dir, """WITH t AS (SELECT id, label, grupo FROM territories(TABLE(SELECT * FROM {points}) PARTITION BY (grupo) ORDER BY (id), '{"algoritmo": "sweep", "max_pdv_cluster": 12}'))
SELECT grupo, id, ordem, round(km_rota, 2) AS km, round(min_rota, 1) AS minutos FROM tours(TABLE(SELECT concat_ws('-', p.grupo, label) AS grupo, p.id, lat, lon FROM {points} p JOIN t USING (id)) PARTITION BY (grupo) ORDER BY (id), '{"v_kmh": 40}')""")
