"""Aggregates and windows behind lists, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key; the order, newest first, must be total."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def dominant(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The commonest value of the columns for each key; ties go by the values. Counted before ranking."""
    counts = df.groupBy(key, *columns).agg(F.count("*").alias("n"))
    return latest(counts, [key], [F.desc("n"), *[F.col(c) for c in columns]])


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the total row count; the total is aggregated apart, not by a window over all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def median_rank(n: Column) -> Column:
    """The place, from 0, of element n // 2 of n values in order."""
    return F.floor(n / 2)


def p95_rank(n: Column) -> Column:
    """The place of element int(0.95 n) - 1; of the only one, if there is one."""
    return F.when(n < 2, 0).otherwise(F.floor(n * 0.95) - 1)


def nearest_p95_rank(n: Column) -> Column:
    """The place of element round(0.95 (n - 1)), halves to even."""
    return F.bround(F.lit(0.95) * (n - 1))


def ranked_values(df: DataFrame, keys: list[str], value: str, **ranks) -> DataFrame:
    """(keys, ...): for each key the value at each named place among its values in order, a place being a function of their number.

    Equal values are counted first, and a running count over the different ones finds the places: no key's values are gathered in a
    row. Null values do not count; keys with null values only are left out.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    placed = counted.withColumn("_upto", upto).withColumn("_total", total)
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > rank(F.col("_total")), F.col(value))).alias(name) for name, rank in ranks.items()])


def one_a_key(df: DataFrame, keys: list[str], columns: list[Column], name: str) -> DataFrame:
    """(keys, name): the columns as a struct, once a key: of several rows of a key the smallest struct, so that a join by the key repeats no row."""
    return df.groupBy(*keys).agg(F.min(F.struct(*columns)).alias(name))


def weighted_centre(df: DataFrame, key: str, lat: str, lon: str, weight: str) -> DataFrame:
    """(key, lat, lon): weighted means, plain ones where the weights sum to 0."""
    total = F.sum(weight)
    mean = lambda c: F.when(total == 0, F.avg(c)).otherwise(F.sum(F.col(c) * F.col(weight)) / total)
    return df.groupBy(key).agg(mean(lat).alias(lat), mean(lon).alias(lon))


def ratio(a: Column, b: Column, places: int = 2) -> Column:
    """a / b rounded; null over 0."""
    return F.round(a / F.when(b != 0, b), places)


def isolated(df: DataFrame, key: str, distance: str, factor: float = 3.0) -> DataFrame:
    """df with isolado: farther than factor times the group's mean distance. Means are aggregated and joined back."""
    means = df.groupBy(key).agg((F.avg(distance) * factor).alias("_limit"))
    return df.join(means, key).withColumn("isolado", F.col(distance) > F.col("_limit")).drop("_limit")


def compact_labels(df: DataFrame, label: str, out: str) -> DataFrame:
    """Labels renumbered 0, 1, 2, ... in their order, by ranking the distinct labels alone."""
    ranks = df.select(label).distinct().withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(ranks, label)


def natural_number(c: Column) -> Column:
    """The number in a name such as R10."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), a null value included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def two_level_summary(parts: DataFrame, stops: DataFrame, key: str, km: str, minutes: str) -> DataFrame:
    """Totals of a key from its parts and from their stops, each aggregated before they meet, so neither multiplies the other."""
    a = parts.groupBy(key).agg(F.count("*").alias("rotas"), F.round(F.sum(km), 2).alias("km_total"), F.round(F.avg(minutes), 2).alias("tempo_medio"))
    b = stops.groupBy(key).agg(F.count("*").alias("pdvs"))
    return a.join(b, key, "left").withColumn("pdvs", F.coalesce("pdvs", F.lit(0)))


def operational_routes(routes: DataFrame, stops: DataFrame, pdvs: DataFrame, uf: str | None = None, cidade: str | None = None) -> DataFrame:
    """(columns of routes, centro_lat, centro_lon): routes with the mean place of their stops, of a state or a city (in any case) only, if given.

    routes and stops meet by cluster_id and subcluster_seq, stops (pdv_id, lat, lon) and pdvs (id, uf, cidade) by the point. A route of which no stop
    fits has no row; the centre is that of the fitting stops. Unknown points fit only where nothing is asked for. Means are taken before the join with routes.
    """
    keys = ["cluster_id", "subcluster_seq"]
    own = stops
    if uf or cidade:
        asked = pdvs if not uf else pdvs.where(F.col("uf") == uf)
        asked = asked if not cidade else asked.where(F.lower("cidade") == cidade.lower())
        own = stops.join(asked.select(F.col("id").alias("pdv_id")), "pdv_id", "left_semi")
    centre = own.groupBy(*keys).agg(F.avg("lat").alias("centro_lat"), F.avg("lon").alias("centro_lon"))
    return routes.join(centre, keys).select(*routes.columns, "centro_lat", "centro_lon")


def points_in_clusters(pdvs: DataFrame, stops: DataFrame, routes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(columns of pdvs with pdv_id for id, cluster_id, cluster_nome, cluster_centro_lat, cluster_centro_lon, subcluster_numero, ordem_rota): each stop with its point, route and cluster; stops that lack one of them have no row."""
    named = clusters.select(F.col("id").alias("cluster_id"), F.col("nome").alias("cluster_nome"), F.col("centro_lat").alias("cluster_centro_lat"), F.col("centro_lon").alias("cluster_centro_lon"))
    placed = stops.select("cluster_id", "subcluster_seq", "pdv_id", "ordem").join(routes.select("cluster_id", "subcluster_seq"), ["cluster_id", "subcluster_seq"]).join(named, "cluster_id")
    whole = placed.join(pdvs.withColumnRenamed("id", "pdv_id"), "pdv_id")
    shown = ["pdv_id" if c == "id" else c for c in pdvs.columns]
    return whole.select(*shown, "cluster_id", "cluster_nome", "cluster_centro_lat", "cluster_centro_lon", F.col("subcluster_seq").alias("subcluster_numero"), F.col("ordem").alias("ordem_rota"))


def sector_statistics(parts: DataFrame, keys: list[str], minutes: str, km: str) -> DataFrame:
    """(keys, n, tempo_medio, tempo_max, dist_media, dist_max) over the subclusters of each sector; sectors all of whose values are null have null figures."""
    return parts.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(minutes).alias("tempo_medio"), F.max(minutes).alias("tempo_max"), F.avg(km).alias("dist_media"), F.max(km).alias("dist_max"))
