"""Queries of sources, sinks and streams over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from campovia.operators import upserts
from campovia.plans.base import POINTS, points, query
from campovia.session import shared_dir, table
from campovia.sources import readers, sinks
from campovia.streaming import chunks, events


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/flows-{uuid.uuid4().hex}"


@query("src01_src02_src03_src04_csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def src01(spark, sf_dir):
    """Written with semicolons, read back as text with the separator sniffed."""
    path = _folder(spark)
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path)
    return readers.csv_sheet(spark, path)


@query("src05_without_empty_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def src05(spark, sf_dir):
    odd = F.col("c_custkey") % 2 == 1
    return readers.without_empty_rows(table(spark, sf_dir, "customer").select(F.when(odd, F.col("c_custkey")).alias("c_custkey"), F.when(odd, F.col("c_name")).alias("c_name")))


@query("src06_src07_scan_namespaced", "SELECT n_nationkey, n_name FROM nation")
def src06(spark, sf_dir):
    """A scan with retries; the name is taken from the namespace that is always there."""
    return readers.with_retries(lambda: table(spark, sf_dir, readers.namespaced("nation"))).select("n_nationkey", "n_name")


@query("src08_geojson_polygons", "SELECT n_name AS cidade, 'SP' AS uf, 1 AS rings, 5 AS corners FROM nation")
def src08(spark, sf_dir):
    path = _folder(spark)
    n = table(spark, sf_dir, "nation")
    ring = F.concat(F.lit("[[[0,0],[1,0],[1,1],[0,1],[0,0]]]"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"nome":"'), "n_name", F.lit('","uf":"SP"},"geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    sinks.feature_collection(n.select("n_nationkey", feature.alias("f")), "f", ["n_nationkey"]).coalesce(1).write.text(path)
    got = readers.geojson_polygons(spark, path, "nome", "uf")
    return got.select("cidade", "uf", F.size("rings").alias("rings"), F.size(F.get("rings", F.lit(0))).alias("corners"))


@query("src09_gathered_results", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def src09(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("src12_resolved_ceps", "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cep, CASE WHEN c_custkey % 2 = 0 THEN 'CACHE' ELSE 'SEGUNDO' END AS cidade FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def src12(spark, sf_dir):
    """The cache knows even postcodes, the first provider has no state for its answers, the second knows every third."""
    c = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("cep"), "c_custkey")
    source = lambda hit, city, uf: c.where(hit).select("cep", F.lit(city).alias("cidade"), F.lit(uf).alias("uf"))
    return readers.resolved_ceps(c, source("c_custkey % 2 = 0", "CACHE", "SP"), [source("true", "PRIMEIRO", "SPX"), source("c_custkey % 3 = 0", "SEGUNDO", "SP")]).select("cep", "cidade")


@query("snk01_snk02_decimals", f"WITH {POINTS} SELECT id, format('{{:.5f}}', lat) AS point, replace(format('{{:.4f}}', lon), '.', ',') AS comma FROM points")
def snk01(spark, sf_dir):
    p = points(spark, sf_dir)
    a = sinks.decimals(p.select("id", F.col("lat").alias("point")), 5)
    return a.join(sinks.decimals(p.select("id", F.col("lon").alias("comma")), 4, comma=True), "id")


@query("snk03_json_round_trip", "SELECT n_nationkey, n_name FROM nation")
def snk03(spark, sf_dir):
    path, n = _folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sinks.write_json(n, path)
    return spark.read.schema(n.schema).json(path)


@query("snk04_sheets", "SELECT 'detalhe' AS sheet, count(*) AS n FROM nation UNION ALL SELECT 'resumo', count(*) FROM region")
def snk04(spark, sf_dir):
    path = _folder(spark)
    sinks.write_sheets({"detalhe": table(spark, sf_dir, "nation"), "resumo": table(spark, sf_dir, "region")}, path)
    count = lambda s: readers.csv_sheet(spark, f"{path}/{s}").agg(F.count("*").alias("n")).select(F.lit(s).alias("sheet"), "n")
    return count("detalhe").union(count("resumo"))


@query("snk05_geojson", "SELECT o_custkey, count(*) AS features FROM orders GROUP BY o_custkey")
def snk05(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = sinks.point_feature(F.lit(-22.0), F.lit(-48.0), pedido=F.col("o_orderkey"))
    whole = sinks.feature_collection(o.select("o_custkey", "o_orderkey", f.alias("f")), "f", ["o_orderkey"], "o_custkey")
    return whole.select("o_custkey", F.size(F.from_json("geojson", "features array<struct<type: string>>")["features"]).cast("long").alias("features"))


@query("snk06_map_layers", f"WITH {POINTS} SELECT state, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS peso FROM points GROUP BY state")
def snk06(spark, sf_dir):
    """The data behind the maps: each territory's centre and weight."""
    g = points(spark, sf_dir).groupBy("state").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("peso"))
    return g.select("state", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "peso")


@query("snk07_append", "SELECT r_regionkey, count(*) AS n FROM region, (SELECT unnest([1, 2])) GROUP BY r_regionkey")
def snk07(spark, sf_dir):
    path, r = _folder(spark), table(spark, sf_dir, "region")
    sinks.append_rows(r, path)
    sinks.append_rows(r, path)
    return spark.read.schema(r.schema).parquet(path).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("snk16_snapshot", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def snk16(spark, sf_dir):
    path, n = _folder(spark), table(spark, sf_dir, "nation")
    upserts.snapshot({"nation": n.where("n_regionkey = 0")}, path, "a")
    upserts.snapshot({"nation": n.where("n_regionkey = 1")}, path, "b")
    return upserts.restore(spark, path, "nation", "b").select("n_nationkey", "n_name")


_DAYS = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query("str_windowed_counts_batch", _DAYS)
def windowed(spark, sf_dir):
    counts = events.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return counts.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _stream(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_windowed_counts_stream", _DAYS)
def windowed_stream(spark, sf_dir):
    """The same counts from a stream that reads the table once."""
    name = f"windowed_{uuid.uuid4().hex}"
    counts = events.windowed_counts(_stream(spark, sf_dir), "ts", "event_type", "value")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(round(epoch_us(min(ts)) / 1e6) AS BIGINT) AS start_s, CAST(round(epoch_us(max(ts)) / 1e6) AS BIGINT) AS last_s, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    second = lambda c: F.round(F.unix_micros(c) / 1e6).cast("long")
    return events.sessions(e, "ts", "user_id", "12 hours").select("user_id", second(F.col("start")).alias("start_s"), (second(F.col("end")) - 43_200).alias("last_s"), "n")


@query("str_process_once", "SELECT user_id AS chunk, user_id * 2 AS doubled FROM events GROUP BY user_id")
def process_once(spark, sf_dir):
    """Each user is a chunk of work that is done once."""
    path = _folder(spark)
    items = _stream(spark, sf_dir).select(F.col("user_id").alias("chunk"))
    events.process_once(items, "chunk", f"{path}/done", lambda df: df.select("chunk", (F.col("chunk") * 2).alias("doubled")), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("chunk", "doubled")


@query("str_progress", "SELECT user_id AS job, count(DISTINCT event_type) AS done, least(100.0::DOUBLE, round(100 * count(DISTINCT event_type) / 5::DOUBLE, 2)) AS percent FROM events GROUP BY user_id")
def progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("chunk"), F.lit(5).alias("total"))
    return events.progress(e, "job", "chunk", "total")


def _answered_later(e):
    """Events as messages: an even one sends a chunk of work out, the odd one after it is the answer, but each seventh is lost."""
    odd = F.col("event_id") % 2
    rows = e.where((odd == 0) | (F.col("event_id") % 7 != 3))
    return rows.select((F.col("event_id") % 16 - odd).cast("string").alias("job"), F.floor(F.col("event_id") / 2).alias("chunk"), F.when(odd == 0, "pedido").otherwise("resposta").alias("tipo"), "ts", F.col("event_id").alias("id"))


_LATER = """m AS (SELECT q.event_id AS id, epoch_us(q.ts) AS asked, CASE WHEN a.event_id % 7 <> 3 THEN epoch_us(a.ts) END AS came, (SELECT max(epoch_us(ts)) - 600000000 FROM events WHERE event_id % 2 = 0 OR event_id % 7 <> 3) AS mark FROM events q LEFT JOIN events a ON a.event_id = q.event_id + 1 WHERE q.event_id % 2 = 0),
o AS (SELECT *, coalesce(came > asked + 600000000, mark >= asked + 600000000) AS again, coalesce(came > asked + 1200000000, mark >= asked + 1200000000) AS lost FROM m)"""


@query("geo22_chunk_outcomes", f"""WITH {_LATER} SELECT CAST(id % 16 AS VARCHAR) AS job, id // 2 AS chunk, 'repetir' AS situacao, 2 AS tentativa FROM o WHERE again
UNION ALL SELECT CAST(id % 16 AS VARCHAR), id // 2, CASE WHEN lost THEN 'falhou' ELSE 'concluido' END, CASE WHEN again THEN 2 ELSE 1 END FROM o WHERE lost OR came IS NOT NULL""")
def chunk_outcomes(spark, sf_dir):
    """Chunks of ten minutes' patience and one retry, as a stream; what is still waiting when the table ends has no row."""
    path = _folder(spark)
    outcomes = chunks.chunk_outcomes(_answered_later(_stream(spark, sf_dir)), "ts", 600, late="10 minutes")
    outcomes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(chunks.OUTCOME).parquet(f"{path}/out").select("job", "chunk", "situacao", "tentativa")


@query("src09_gathered_by_kind", """WITH r AS (SELECT user_id AS job, event_id // 10 AS chunk, event_id, CASE event_id % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'hash' ELSE 'set' END AS estrutura, event_type AS campo, CAST(event_id % 50 AS VARCHAR) AS valor FROM events)
SELECT job, estrutura, NULL AS campo, row_number() OVER (PARTITION BY job ORDER BY event_id) - 1 AS posicao, valor FROM r WHERE estrutura = 'list'
UNION ALL SELECT job, estrutura, campo, NULL, arg_max(valor, event_id) FROM r WHERE estrutura = 'hash' GROUP BY job, estrutura, campo UNION ALL SELECT DISTINCT job, estrutura, NULL, NULL, valor FROM r WHERE estrutura = 'set'""")
def gathered_by_kind(spark, sf_dir):
    """Each user's events as answers in chunks of ten, every chunk told twice."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("list", "hash", "set")]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.floor(F.col("event_id") / 10).alias("chunk"), F.col("event_id").alias("ordem"), kind.alias("estrutura"), F.col("event_type").alias("campo"), (F.col("event_id") % 50).cast("string").alias("valor"))
    return chunks.gathered(rows.unionByName(rows))
