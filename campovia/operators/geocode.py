"""Geocoding over lookup tables: cache first, then providers in order, each answer checked; and repairs of what failed.

A provider is a table (key, lat, lon[, kind]) of answers, so the cascade is a chain of joins on distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campovia.functions.geo import REGION_BOX, at_city_centre, box, generic, point_status
from campovia.functions.ids import cep_fits_state, geocoding_reason
from campovia.functions.text import cache_key, contains_all
from campovia.operators.dedup import append_missing, first_by
from campovia.operators.reports import one_a_key
from campovia.operators.spatial import point_in_place

# Result kinds that name more than an address, and sources and statuses.
COARSE_KINDS = ("city", "town", "village", "municipality", "county", "state", "region", "country", "postcode", "administrative")
CITY_FALLBACK, OVERRIDE = "fallback_cidade", "google_override"


def needs_input(street: Column, city: Column, uf: Column) -> Column:
    """A street, city or state is blank."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return blank(street) | blank(city) | blank(uf)


def cascade(requests: DataFrame, key: str, uf: str, sources: list[tuple[str, DataFrame]], polygons: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """requests (unique keys) with lat, lon, source: the first source with a believed answer, else "falha".

    An answer is believed if it is not generic, lies in the state's box, is of a fine enough kind, and, with polygons (table, keys), lies in its place:
    an unknown place is not. The first source, the cache, is checked for the box alone. Of several answers of a source for a key the smallest counts.
    """
    out = requests
    for i, (_, table) in enumerate(sources):
        kind = F.col("kind") if "kind" in table.columns else F.lit(None).cast("string")
        out = out.join(one_a_key(table, [key], [F.col("lat").alias("lat"), F.col("lon").alias("lon"), kind.alias("kind")], f"_s{i}"), key, "left")
        lat, lon = F.col(f"_s{i}.lat"), F.col(f"_s{i}.lon")
        good = point_status(lat, lon, F.col(uf)) == "ok"
        if i:
            good = good & ~generic(lat, lon, with_points=False) & ~at_city_centre(lat, lon) & ~F.coalesce(F.lower(F.col(f"_s{i}.kind")).isin(*COARSE_KINDS), F.lit(False))
            if polygons is not None:
                placed = out.withColumn("_lat", lat).withColumn("_lon", lon)
                out = point_in_place(placed, polygons[0], polygons[1], "_lat", "_lon").withColumn(f"_in{i}", F.coalesce("dentro", F.lit(False))).drop("_lat", "_lon", "dentro")
                good = good & F.col(f"_in{i}")
        out = out.withColumn(f"_a{i}", F.when(good, F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(sources[i][0]).alias("source"))))
    best = F.coalesce(*[F.col(f"_a{i}") for i in range(len(sources))])
    chosen = out.withColumn("_best", best)
    return chosen.select(*requests.columns, F.col("_best.lat").alias("lat"), F.col("_best.lon").alias("lon"), F.coalesce("_best.source", F.lit("falha")).alias("source"))


def geocode_batch(addresses: DataFrame, cache: DataFrame, providers: list[tuple[str, DataFrame]], polygons: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """addresses (id, logradouro, numero, cidade, uf, ...) with lat, lon, source; rows without street, city or state are invalid_input.

    Keys are built, each distinct key is looked up once, and results go back to every row.
    """
    cells = [F.col(c) for c in ("logradouro", "numero", "cidade", "uf")]
    lacking = needs_input(cells[0], cells[2], cells[3])
    keyed = addresses.withColumn("key", F.when(~lacking, cache_key(*cells)))
    wanted = first_by(keyed.where("key IS NOT NULL").select("key", "cidade", "uf"), ["key"], [F.col("cidade"), F.col("uf")])
    found = cascade(wanted, "key", "uf", [("cache", cache), *providers], polygons).select("key", "lat", "lon", "source")
    return keyed.join(found, "key", "left").withColumn("source", F.coalesce("source", F.lit("invalid_input"))).select(*addresses.columns, "key", "lat", "lon", "source")


def area_geocode(areas: DataFrame, cache: DataFrame, by_district: DataFrame, by_city: DataFrame, fallback: DataFrame) -> DataFrame:
    """areas (cep, bairro, cidade, uf) with lat, lon, source: the postcode cache, else by district, by city, or the fallback, inside the regional box."""
    out = areas
    for i, (table, keys) in enumerate(((cache, ["cep"]), (by_district, ["bairro", "cidade", "uf"]), (by_city, ["cidade", "uf"]), (fallback, ["cep"]))):
        out = out.join(table.select(*keys, F.struct("lat", "lon").alias(f"_s{i}")), keys, "left")
    names = ("cache", "bairro", "cidade", "fallback")
    best = F.coalesce(*[F.when(box(F.col(f"_s{i}.lat"), F.col(f"_s{i}.lon"), REGION_BOX), F.struct(F.col(f"_s{i}.lat").alias("lat"), F.col(f"_s{i}.lon").alias("lon"), F.lit(n).alias("source"))) for i, n in enumerate(names)])
    return out.withColumn("_b", best).select(*areas.columns, F.col("_b.lat").alias("lat"), F.col("_b.lon").alias("lon"), F.coalesce("_b.source", F.lit("falha")).alias("source"))


def statistics(results: DataFrame, source: str = "source") -> DataFrame:
    """(total, cache_hits, falhas, taxa): counts and the share with coordinates in percent."""
    hit = lambda s: F.count(F.when(F.col(source) == s, 1))
    lost = F.count(F.when(F.col(source).isin("falha", "invalid_input"), 1))
    return results.agg(F.count("*").alias("total"), hit("cache").alias("cache_hits"), lost.alias("falhas"), F.round(100 * (F.count("*") - lost) / F.count("*"), 2).alias("taxa"))


def split_known_cities(rows: DataFrame, cities: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of listed cities, and the others marked cidade_invalida."""
    known = cities.select(*keys).distinct()
    return rows.join(known, keys, "left_semi"), rows.join(known, keys, "left_anti").withColumn("motivo_invalidade", F.lit("cidade_invalida"))


def judge(results: DataFrame, polygons: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """results with status: valid, fora_municipio or falha; an unknown place is outside."""
    placed = point_in_place(results, polygons, keys, lat, lon, unknown=False)
    status = F.when(F.col(lat).isNull() | F.col(lon).isNull(), "falha").when(F.col("dentro"), "valid").otherwise("fora_municipio")
    return placed.withColumn("status", status).drop("dentro")


def reprocess(invalid: DataFrame, city_points: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """invalid (id, cidade, uf, status, source, lat, lon) with second tries: new lat, lon, source, and recuperado.

    falha: the city's point. fora_municipio from google: the city's point; from the cache or nominatim: the override (id, lat, lon), else the city's point.
    Everything else is final. A row counts as recovered only if a coordinate was found.
    """
    city = city_points.select("cidade", "uf", F.struct("lat", "lon", F.lit(CITY_FALLBACK).alias("source")).alias("_city"))
    over = overrides.select(key, F.struct("lat", "lon", F.lit(OVERRIDE).alias("source")).alias("_over"))
    both = invalid.join(city, ["cidade", "uf"], "left").join(over, key, "left")
    outside = F.col("status") == "fora_municipio"
    retry = (
        F.when((F.col("status") == "falha") | (outside & (F.col("source") == "google")), F.col("_city"))
        .when(outside & F.col("source").isin("cache", "nominatim"), F.coalesce("_over", "_city"))
    )
    tried = both.withColumn("_new", retry)
    pick = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c)
    rest = [c for c in invalid.columns if c not in ("lat", "lon", "source")]
    return tried.select(*rest, pick("lat"), pick("lon"), pick("source"), F.col("_new.lat").isNotNull().alias("recuperado"))


def revalidated(valid: DataFrame, retried: DataFrame, polygons: DataFrame, keys: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Valid rows with the recovered ones that lie in their place, and the rest of the retried rows; no id is in both."""
    judged = judge(retried.where("recuperado").drop("status"), polygons, keys).where("status = 'valid'")
    good = append_missing(valid, judged.select(*[c for c in valid.columns if c in judged.columns]), key)
    return good, retried.join(good.select(key), key, "left_anti")


def cache_rows(results: DataFrame) -> DataFrame:
    """What may be written to the cache: not a city's point, with a house number, a key of ten characters or more and without NAN."""
    ok = (F.col("source") != CITY_FALLBACK) & (F.trim(F.coalesce("numero", F.lit(""))) != "") & (F.length("key") >= 10) & ~F.col("key").contains("NAN") & F.col("lat").isNotNull()
    return results.where(F.coalesce(ok, F.lit(False))).select("key", "lat", "lon", F.col("source").alias("origem"))


def corrected_by_cep(invalid: DataFrame, ceps: DataFrame) -> DataFrame:
    """invalid with city and state as the postcode table (cep, cidade, uf) has them, and corrigido.

    Only rows that failed for their city, with eight digits of postcode that fit the found state, and another city or state than before.
    """
    found = ceps.select("cep", F.col("cidade").alias("_cidade"), F.col("uf").alias("_uf")).where("length(_uf) = 2 AND _cidade IS NOT NULL")
    both = invalid.join(found, "cep", "left")
    differs = ~F.upper("cidade").eqNullSafe(F.upper("_cidade")) | ~F.upper("uf").eqNullSafe(F.upper("_uf"))
    fix = (F.col("motivo_invalidade") == "cidade_invalida") & F.col("cep").rlike("^[0-9]{8}$") & F.col("_uf").isNotNull() & cep_fits_state(F.col("cep"), F.col("_uf")) & differs
    fix = F.coalesce(fix, F.lit(False))
    pick = {"cidade": F.when(fix, F.col("_cidade")).otherwise(F.col("cidade")), "uf": F.when(fix, F.col("_uf")).otherwise(F.col("uf"))}
    return both.select(*[pick.get(c, F.col(c)).alias(c) for c in invalid.columns], fix.alias("corrigido"))


def with_reason(results: DataFrame, status: str) -> DataFrame:
    """results with motivo_invalidade for their geocoding status."""
    return results.withColumn("motivo_invalidade", geocoding_reason(F.col(status)))


def reverse_lookup(points: DataFrame, cache: DataFrame, key: str, lat: str, lon: str, near: float = 1e-6) -> DataFrame:
    """points with the address (cache: lat, lon, endereco) within `near` degrees, the alphabetically first of several; rows meet by grid cell."""
    size = near * 4
    cell = lambda c: F.floor(c / size).cast("long")
    side = F.array(F.lit(-1), F.lit(0), F.lit(1))
    grid = cache.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "endereco", cell(F.col("lat")).alias("_y"), cell(F.col("lon")).alias("_x"))
    asked = points.select(key, lat, lon, F.explode(side).alias("_dy")).withColumn("_dx", F.explode(side))
    asked = asked.withColumn("_y", cell(F.col(lat)) + F.col("_dy")).withColumn("_x", cell(F.col(lon)) + F.col("_dx"))
    hits = asked.join(grid, ["_y", "_x"]).where((F.abs(F.col(lat) - F.col("_lat")) < near) & (F.abs(F.col(lon) - F.col("_lon")) < near))
    return points.join(hits.groupBy(key).agg(F.min("endereco").alias("endereco")), key, "left")


def find_in_cache(cache: DataFrame, terms: list[str], source: str | None = None) -> DataFrame:
    """Cache rows whose key has all terms; no terms find nothing."""
    hit = contains_all(F.col("key"), terms)
    return cache.where(hit if source is None else hit & (F.col("origem") == source))


#: Parts of an address that name a district, the first given one counts; fixed values of the providers' answers.
DISTRICT_PARTS = ("suburb", "neighbourhood", "city_district", "village", "town", "city")
UNKNOWN_DISTRICT = "Não identificado"


def districts(points: DataFrame, answers: DataFrame, fallback: DataFrame, lat: str = "lat", lon: str = "lon", district: str = "bairro") -> DataFrame:
    """points with blank districts looked up by their coordinates of six decimals; what is given stays.

    answers: (y, x, endereco), the parts of an address as a map, at whole millionths of a degree; fallback: (y, x, bairro). Each place is looked up
    once, however many points share it; where nothing names it, or coordinates are missing, it is not identified.
    """
    million = lambda c: F.round(F.col(c) * 1e6).cast("long")
    given = F.nullif(F.trim(F.col(district)), F.lit(""))
    asked = points.withColumn("_asked", given.isNull()).withColumns({"_y": F.when(F.col("_asked"), million(lat)), "_x": F.when(F.col("_asked"), million(lon))})
    places = asked.where("_y IS NOT NULL AND _x IS NOT NULL").select(F.col("_y").alias("y"), F.col("_x").alias("x")).distinct()
    named = F.coalesce(*[F.nullif(F.trim(F.element_at("endereco", part)), F.lit("")) for part in DISTRICT_PARTS])
    first = answers.select("y", "x", named.alias("_d")).groupBy("y", "x").agg(F.min("_d").alias("_first"))
    second = fallback.groupBy("y", "x").agg(F.min(F.nullif(F.trim("bairro"), F.lit(""))).alias("_second"))
    found = places.join(first, ["y", "x"], "left").join(second, ["y", "x"], "left").select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.coalesce("_first", "_second").alias("_found"))
    blanks = asked.where("_asked").join(found, ["_y", "_x"], "left").withColumn(district, F.coalesce("_found", F.lit(UNKNOWN_DISTRICT)))
    return asked.where("NOT _asked").select(*points.columns).unionByName(blanks.select(*points.columns))
