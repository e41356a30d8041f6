"""Table sources: text sheets of any separator and encoding, JDBC with retries, namespaces, GeoJSON polygons, provider tables."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACES = ("public", "operacional")
SEPARATORS = (";", ",", "\t", "|")


def first_line(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """A text file's first line, read through Spark so that any store will do."""
    rows = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    return rows[0][0].lstrip("﻿") if rows else ""


def separator(spark: SparkSession, path: str, choices: tuple[str, ...] = (";", ",")) -> str:
    """The first of the choices that the header has, else the last."""
    head = first_line(spark, path)
    return next((s for s in choices if s in head), choices[-1])


def csv_sheet(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """A sheet with all cells as text, empty ones as "". The separator is sniffed; bytes that are no UTF-8 are read as Latin-1."""
    sep = sep or separator(spark, path, SEPARATORS)
    read = lambda enc: spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding=enc, multiLine=True, escape='"')
    if encoding is None:
        encoding = "iso-8859-1" if not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "utf-8"
    sheet = read(encoding)
    return sheet.toDF(*[c.lstrip("﻿") for c in sheet.columns]).na.fill("")


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """A sheet by its name's ending: csv (comma, else semicolon), json, parquet or orc. Workbooks must be saved as one of these first."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        return csv_sheet(spark, path, separator(spark, path, (",", ";")))
    if kind in ("json", "parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"sheets of type {kind} cannot be read here")


def without_empty_rows(df: DataFrame) -> DataFrame:
    """df without rows that are null throughout; an error if none is left."""
    kept = df.dropna(how="all")
    if kept.isEmpty():
        raise ValueError("the sheet has no rows")
    return kept


def with_retries(action: Callable[[], DataFrame], tries: int = 5, delay: float = 2.0, backoff: float = 1.5) -> DataFrame:
    """The action's result; after an error it is tried again, waiting longer each time."""
    for n in range(tries):
        try:
            return action()
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(delay * backoff**n * random.uniform(0.9, 1.1))
    raise ValueError("no tries")


def jdbc(spark: SparkSession, url: str, query: str, user: str, password: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database query, read in ranges of a column (name, low, high, parts) where given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS q").option("user", user).option("password", password)
    if partition:
        for option, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition):
            reader = reader.option(option, value)
    return with_retries(reader.load)


def namespaced(name: str, namespace: str = "public") -> str:
    """A table's name in one of the two namespaces."""
    if namespace not in NAMESPACES:
        raise ValueError(f"unknown namespace {namespace}")
    return name if namespace == "public" else f"{namespace}.{name}"


def geojson_polygons(spark: SparkSession, path: str, city: str, uf: str) -> DataFrame:
    """(cidade, uf, rings) of a FeatureCollection of Polygons and MultiPolygons; features without city, state or geometry are skipped.

    Rings are arrays of (lon, lat); all rings of a feature are in one array, so that holes count by crossing twice.
    """
    point = "array<double>"
    shape = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    feature = spark.read.json(path, schema=shape, multiLine=True).select(F.explode("features").alias("f"))
    rows = feature.select(F.col("f.properties")[city].alias("cidade"), F.col("f.properties")[uf].alias("uf"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rings = F.when(F.col("kind") == "Polygon", F.from_json("c", f"array<array<{point}>>")).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", f"array<array<array<{point}>>>")))
    named = rows.withColumn("rings", F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))
    return named.where("cidade IS NOT NULL AND uf IS NOT NULL AND rings IS NOT NULL").select("cidade", "uf", "rings")


def resolved_ceps(ceps: DataFrame, cache: DataFrame, providers: list[DataFrame]) -> DataFrame:
    """(cep, cidade, uf) from the cache, else the first provider with a city and two state letters; unresolved postcodes are left out."""
    out = ceps.select("cep").distinct()
    for i, source in enumerate([cache, *providers]):
        good = source.where("cidade IS NOT NULL AND length(uf) = 2").groupBy("cep").agg(F.min(F.struct("cidade", "uf")).alias(f"_s{i}"))
        out = out.join(good, "cep", "left")
    best = F.coalesce(*[F.col(f"_s{i}") for i in range(len(providers) + 1)])
    return out.withColumn("_b", best).where("_b IS NOT NULL").select("cep", "_b.cidade", "_b.uf")
