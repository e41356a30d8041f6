"""Cleaning of uploaded sheets, and rows that come in by hand or from the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campovia.functions import dates, geo, ids, text
from campovia.operators import dedup, filters
from campovia.operators.upserts import insert_new, upsert
from campovia.session import durable

MARKET_REQUIRED = ["cidade", "uf", "cep", "clientes_total"]


def clean_points(sheet: DataFrame, row: str, number_required: bool = False, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """An uploaded sheet of points of sale (all text, with a row number) as (valid, invalid).

    Names are made canonical, cells cleaned by type, missing company ids replaced by synthetic ones from the row number, a number at the
    end of a street parted from it, the address key built. Rows that lack a required field, share a company id, or have one that is
    stored already (stored: cnpj) are invalid with their reasons. Of these one row a company id is kept: the first that lacks a field, else
    the first at all, so a company id's other reasons are lost.
    """
    named = filters.canonical_columns(sheet)
    filters.assert_columns(named, ["cnpj", "logradouro", "cidade", "uf", "cep"])
    has = lambda c: F.col(c) if c in named.columns else F.lit(None).cast("string")
    cell = lambda c: F.coalesce(text.null_sentinels(text.without_controls(has(c))), F.lit(""))
    street, number = text.street_and_number(F.col("_street"))
    stated = F.col("_number")
    # Cells that are used often are columns of their own first; the array keeps them from being written out at each use.
    first = F.array(F.trim(F.regexp_replace(cell("logradouro"), ",.*$", "")), text.house_number(cell("numero")), ids.cnpj_from_cell(cell("cnpj")))
    named = named.withColumn("_cells", F.transform(first, lambda x: x))
    named = named.withColumns({"_street": F.get("_cells", F.lit(0)), "_number": F.get("_cells", F.lit(1)), "_cnpj": F.get("_cells", F.lit(2))})
    cleaned = durable(named.select(  # read several times below
        F.col(row).alias("linha"),
        F.coalesce(F.nullif(F.col("_cnpj"), F.lit("")), ids.synthetic_cnpj(F.col(row))).alias("cnpj"),
        F.when(stated == "", street).otherwise(cell("logradouro")).alias("logradouro"),
        F.when(stated == "", F.coalesce(number, F.lit(""))).otherwise(stated).alias("numero"),
        text.district(cell("bairro"), cell("cidade")).alias("bairro"), F.upper(cell("cidade")).alias("cidade"), F.upper(cell("uf")).alias("uf"),
        ids.cep_strict(cell("cep")).alias("cep"), ids.money(has("pdv_vendas")).alias("pdv_vendas"),
        dates.minutes_of_day(has("janela_atendimento_inicio")).alias("janela_atendimento_inicio"), dates.minutes_of_day(has("janela_atendimento_fim")).alias("janela_atendimento_fim"),
        _service_minutes(has("tempo_atendimento_min")).alias("tempo_atendimento_min"), ids.flag(has("is_estrategico")).alias("is_estrategico"),
    ))
    keyed = cleaned.withColumn("endereco_cache_key", text.cache_key(*[F.col(c) for c in ("logradouro", "numero", "cidade", "uf")]))
    required = ["cnpj", "logradouro", *(["numero"] if number_required else []), "cidade", "uf"]
    filled, lacking = filters.split_required(keyed, required)
    single, repeated = dedup.split_repeated(filled, ["cnpj"])
    rejected = lacking.withColumn("_step", F.lit(0)).unionByName(repeated.withColumn("_step", F.lit(1)))
    if stored is not None:
        known = single.join(stored.select("cnpj").distinct(), "cnpj", "left_semi").withColumn("motivo_invalidade", F.lit("cnpj_duplicado_input_id"))
        rejected = rejected.unionByName(known.withColumn("_step", F.lit(2)))
        single = single.join(stored.select("cnpj"), "cnpj", "left_anti")
    return single, dedup.first_by(rejected, ["cnpj"], [F.col("_step"), F.col("linha")]).drop("_step")


def _service_minutes(c: Column) -> Column:
    value = F.replace(F.trim(F.regexp_replace(c, r"R\$", "")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((value > 0) & (value <= 1440), value)


def clean_market(sheet: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Postcode demand as (valid, invalid with reasons): postcode normalised and in its state's range, counts whole and 0 where missing; repeated postcodes stay."""
    whole = lambda c: F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0)) if c in sheet.columns else F.lit(0)
    filters.assert_columns(sheet, MARKET_REQUIRED)
    cleaned = sheet.select(
        F.col(row).alias("linha"), F.upper(text.without_controls(F.col("cidade"))).alias("cidade"), F.upper(F.trim("uf")).alias("uf"), ids.cep_loose(F.col("cep")).alias("cep"),
        text.null_sentinels(F.col("clientes_total")).alias("_given"), whole("clientes_total").alias("clientes_total"), whole("clientes_target").alias("clientes_target"),
        F.sha2(F.concat_ws("|", F.col(row).cast("string"), "cep"), 256).substr(1, 32).alias("mkp_id"),
    )
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.concat_ws(
        "|", F.when(blank("cidade"), "campo_obrigatorio_cidade"), F.when(blank("uf"), "campo_obrigatorio_uf"), F.when(F.col("cep").isNull(), "cep_invalido"),
        F.when(F.col("_given").isNull(), "campo_obrigatorio_clientes_total"), F.when(F.col("cep").isNotNull() & ~ids.cep_fits_state(F.col("cep"), F.col("uf")), "cep_incompativel_uf"),
    )
    judged = cleaned.withColumn("motivo_invalidade", reason).drop("_given")
    return judged.where("motivo_invalidade = ''").drop("motivo_invalidade"), judged.where("motivo_invalidade <> ''")


def manual_rows(rows: DataFrame, stored: DataFrame, cache: DataFrame, row: str, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with given coordinates as (points to add, rejected with sheet line and reason, new cache).

    The first reason that fits: company id, street, city, state, coordinates missing or generic. Of a company id the first row counts, and none
    that is stored already; those refresh the cache all the same.
    """
    cnpj = ids.cnpj_14(F.col("cnpj"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    reason = (
        F.when(cnpj.isNull(), "cnpj_invalido").when(blank("logradouro"), "logradouro_ausente").when(blank("cidade"), "cidade_ausente").when(F.length(F.trim(F.coalesce("uf", F.lit("")))) != 2, "uf_invalida")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "coordenadas_ausentes").when(geo.generic(F.col("lat"), F.col("lon")), "coordenadas_genericas")
    )
    judged = rows.withColumn("cnpj", F.coalesce(cnpj, F.col("cnpj"))).withColumn("motivo_invalidade", reason).withColumn("linha", F.col(row) + 2)
    good = judged.where("motivo_invalidade IS NULL").withColumn("key", text.cache_key(*[F.col(c) for c in ("logradouro", "numero", "cidade", "uf")]))
    fresh = dedup.first_by(good, ["cnpj"], [F.col(row)]).join(stored.select("cnpj"), "cnpj", "left_anti").withColumn("status_geolocalizacao", F.lit("manual_insert"))
    latest = dedup.first_by(good, ["key"], [F.desc(row)]).select("key", "lat", "lon", F.lit("manual_edit").alias("origem"), F.lit(version).alias("version"))
    return fresh, judged.where("motivo_invalidade IS NOT NULL").select("linha", "cnpj", "motivo_invalidade"), upsert(cache, latest, ["key"], "version")


def from_registry(registry: DataFrame, wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """Active, located registry rows of the wanted ids, without company ids that are loaded already."""
    live = registry.where("ativo AND lat IS NOT NULL AND lon IS NOT NULL")
    return live.join(wanted.select("id"), "id", "left_semi").join(loaded.select("cnpj"), "cnpj", "left_anti")


def prepared_for_geocoding(rows: DataFrame, cities: DataFrame, row: str, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows in chunks, invalid): the city first (cidade_invalida), then street, number, city and state (<field>_invalido)."""
    keyed = rows.withColumn("_city", text.city_key(F.col("cidade"), F.col("uf"))).withColumn("_uf", text.state_key(F.col("uf")))
    listed = cities.select(text.city_key(F.col("cidade"), F.col("uf")).alias("_city"), text.state_key(F.col("uf")).alias("_uf")).distinct()
    unknown = keyed.join(listed, ["_city", "_uf"], "left_anti").withColumn("motivo_invalidade", F.lit("cidade_invalida"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    reason = F.coalesce(*[F.when(blank(c), F.lit(f"{c}_invalido")) for c in ("logradouro", "numero", "cidade", "uf")])
    judged = keyed.join(listed, ["_city", "_uf"], "left_semi").withColumn("motivo_invalidade", reason)
    good = judged.where("motivo_invalidade IS NULL").select(*rows.columns, F.floor(F.col(row) / size).cast("long").alias("chunk"))
    return good, unknown.unionByName(judged.where("motivo_invalidade IS NOT NULL")).select(*rows.columns, "motivo_invalidade")


def register(registry: DataFrame, rows: DataFrame, located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New registry rows as (registry, rejected): normalised, known company ids rejected, coordinates looked up (located: id, lat, lon) only where missing."""
    normal = rows.withColumn("cnpj", ids.registry_cnpj(F.col("cnpj"))).withColumn("uf", F.upper(F.substring(F.trim("uf"), 1, 2))).withColumn("cidade", text.city_name(F.col("cidade")))
    known = normal.join(registry.select("cnpj"), "cnpj", "left_semi").withColumn("motivo", F.lit("cnpj_duplicado"))
    fresh = normal.join(registry.select("cnpj"), "cnpj", "left_anti").join(located.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "id", "left")
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    status = F.when(given, "manual").when(F.col("_lat").isNotNull(), "geocodificado").otherwise("nao_encontrado")
    placed = fresh.withColumn("status", status).withColumn("lat", F.when(given, F.col("lat")).otherwise(F.col("_lat"))).withColumn("lon", F.when(given, F.col("lon")).otherwise(F.col("_lon"))).drop("_lat", "_lon")
    return insert_new(registry, placed.select(*registry.columns), ["cnpj"], [F.col("id")]), known


def update_registry(registry: DataFrame, changes: DataFrame, located: DataFrame) -> DataFrame:
    """registry with changes (id, address cells, lat, lon): a changed address without coordinates takes those looked up, an unchanged one keeps the old; located rows need no review."""
    cells = ["logradouro", "numero", "cidade", "uf"]
    new = changes.select("id", F.struct(*cells, "lat", "lon").alias("n")).join(located.select("id", F.struct("lat", "lon").alias("g")), "id", "left")
    both = registry.join(new, "id", "left")
    moved = F.lit(False)
    for c in cells:
        moved = moved | ~F.col(c).eqNullSafe(F.coalesce(F.col(f"n.{c}"), F.col(c)))
    given = F.col("n.lat").isNotNull() & F.col("n.lon").isNotNull()
    where = lambda c: F.when(F.col("n").isNull(), F.col(c)).when(given, F.col(f"n.{c}")).when(moved, F.col(f"g.{c}")).otherwise(F.col(c))
    lat, lon = where("lat"), where("lon")
    review = F.when(F.col("n").isNotNull() & lat.isNotNull(), False).otherwise(F.col("revisao_pendente"))
    new_cells = {c: F.coalesce(F.col(f"n.{c}"), F.col(c)) for c in cells} | {"lat": lat, "lon": lon, "revisao_pendente": review}
    return both.select(*[new_cells.get(c, F.col(c)).alias(c) for c in registry.columns])
