"""A whole routing run of prepared groups: one run, several outputs, and an error for each group that fails."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.functions.geo import sane
from campovia.operators import heuristics as h
from campovia.operators.filters import missing_reasons
from campovia.operators.numbering import numbered
from campovia.operators.reports import one_a_key
from campovia.operators.routing import SPLITTERS
from campovia.operators.territory import DEFAULTS
from campovia.session import durable

#: Most points of a group of one run: a group is routed in one task.
GROUP_POINTS = 3000
#: Why a group failed, as fixed words in front of the group's name.
NO_BASE, NO_PLACE, TOO_LARGE = "Consultor não encontrado: ", "Consultor sem coordenadas: ", "Grupo grande demais: "


@dataclass(frozen=True)
class RouteRun:
    """What a run leaves.

    rejects: the sheet's rows that cannot be routed, with motivo_invalidade. detail: (grupo_utilizado, rota_id, sequencia, key, lat, lon),
    one row a stop. summary: one row a route. failures: (grupo_utilizado, qtd_pdvs, erro), one row a group that failed. metrics: one row.
    status: done; done_with_warnings if some groups failed; partial_failed if all did.
    """

    rejects: DataFrame
    detail: DataFrame
    summary: DataFrame
    failures: DataFrame
    metrics: DataFrame
    status: DataFrame


def route_groups(groups: DataFrame, key: str, lat: str, lon: str, mode: str = "balanceado", improve: bool = True, **settings) -> DataFrame:
    """(grupo_utilizado, rota, sequencia, key, lat, lon, distancia_km, tempo_min, erro): each group split into routes from its base (base_lat, base_lon).

    What a group raises becomes erro in each of its rows, which then have no route; the other groups go on.
    """
    if mode not in SPLITTERS:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(SPLITTERS)}")
    s = DEFAULTS | {"alpha": 1.3, "kmh": 60.0, "days": 21, "least": 8, "most": 12} | settings
    columns = ["grupo_utilizado", "rota", "sequencia", key, lat, lon, "distancia_km", "tempo_min", "erro"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        xy, base = pdf[[lat, lon]].to_numpy(float), pdf[["base_lat", "base_lon"]].iloc[0].to_numpy(float)
        own = pdf[["grupo_utilizado", key, lat, lon]]
        try:
            parts = []
            for r, members in enumerate(SPLITTERS[mode](xy, np.full(len(xy), float(s["freq"])), s), 1):
                cost = h.route(xy[members], base, s["kmh"], s["service"], s["alpha"], improve)
                stops = own.iloc[members[cost["order"]]]
                parts.append(stops.assign(rota=r, sequencia=np.arange(1, len(stops) + 1), distancia_km=cost["km"], tempo_min=cost["minutes"], erro=None))
            return pd.concat(parts)[columns]
        except (ValueError, ArithmeticError, IndexError) as error:  # bad data of one group must not end the others
            return own.assign(rota=None, sequencia=None, distancia_km=np.nan, tempo_min=np.nan, erro=str(error) or type(error).__name__)[columns]

    kind = {c: groups.schema[c].dataType.simpleString() for c in (key, lat, lon)}
    schema = f"grupo_utilizado string, rota long, sequencia long, `{key}` {kind[key]}, `{lat}` {kind[lat]}, `{lon}` {kind[lon]}, distancia_km double, tempo_min double, erro string"
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.select("grupo_utilizado", key, lat, lon, "base_lat", "base_lon").repartition(parts, "grupo_utilizado")
    return rows.groupBy("grupo_utilizado").applyInPandas(run, schema)


def route_run(sheet: DataFrame, group: str, key: str, lat: str, lon: str, bases: DataFrame, required: list[str], most_points: int = GROUP_POINTS, mode: str = "balanceado", improve: bool = True, **settings) -> RouteRun:
    """Validate a sheet, route each consultant's rows from the consultant's base, and flatten what comes out.

    group: the consultant's column, read without outer spaces and in upper case. bases: (consultor, lat, lon), active ones; of several
    rows of a consultant the least place on the globe counts. Rows that lack a required cell or a place on the globe are rejected with
    all their reasons. A group without a base, without the base's coordinates or of more than most_points rows fails without being
    gathered, one whose routing raises fails in its task; all others are routed. Routes are numbered R1, R2, ... by group name.
    The settings are those of split_routes. An empty sheet gives empty outputs, status done and a success of 0.
    """
    text = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    named = sheet.withColumn("grupo_utilizado", text(group))
    missing = missing_reasons(list(dict.fromkeys([*required, group])))
    misplaced = F.when(~sane(F.col(lat), F.col(lon)), "coordenadas_invalidas")
    reason = F.concat_ws("|", F.when(missing != "", missing), misplaced)
    judged = named.withColumn("motivo_invalidade", reason)
    rejects = judged.where("motivo_invalidade <> ''").select(*sheet.columns, "motivo_invalidade")
    valid = judged.where("motivo_invalidade = ''").select("grupo_utilizado", key, lat, lon)

    # One row a group, made before any group is gathered: what cannot be routed is known by then.
    known = sane(F.col("lat"), F.col("lon"))
    places = one_a_key(bases.select(text("consultor").alias("grupo_utilizado"), (~known).alias("void"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), ["grupo_utilizado"], [F.col(c) for c in ("void", "lat", "lon")], "_base")
    name = F.col("grupo_utilizado")
    error = (
        F.when(F.col("_base").isNull(), F.concat(F.lit(NO_BASE), name))
        .when(F.col("_base.void"), F.concat(F.lit(NO_PLACE), name))
        .when(F.col("qtd_pdvs") > most_points, F.concat(F.lit(TOO_LARGE), name))
    )
    sizes = valid.groupBy("grupo_utilizado").agg(F.count("*").alias("qtd_pdvs"))
    groups = durable(sizes.join(places, "grupo_utilizado", "left").select(name, "qtd_pdvs", F.col("_base.lat").alias("base_lat"), F.col("_base.lon").alias("base_lon"), error.alias("erro")))
    ready = valid.join(groups.where("erro IS NULL").select(name, "base_lat", "base_lon"), "grupo_utilizado")
    routed = durable(route_groups(ready, key, lat, lon, mode, improve, **settings))

    done = routed.where("erro IS NULL")
    routes = done.groupBy("grupo_utilizado", "rota").agg(F.count("*").alias("qtd_pdvs"), F.first("distancia_km").alias("distancia_km"), F.first("tempo_min").alias("tempo_min"))
    numbers = durable(numbered(routes, ["grupo_utilizado", "rota"], "_n").withColumn("rota_id", F.concat(F.lit("R"), F.col("_n") + 1)))
    summary = numbers.select("rota_id", name, F.lit("consultor").alias("fonte_grupo"), "qtd_pdvs", "distancia_km", "tempo_min")
    detail = done.join(numbers.select(name, "rota", "rota_id"), ["grupo_utilizado", "rota"]).select(name, "rota_id", "sequencia", key, lat, lon)
    late = routed.where("erro IS NOT NULL").groupBy("grupo_utilizado").agg(F.count("*").alias("qtd_pdvs"), F.min("erro").alias("erro"))
    failures = groups.where("erro IS NOT NULL").select(name, "qtd_pdvs", "erro").unionByName(late)

    count = lambda df, c: df.agg(F.count("*").alias(c))
    totals = groups.agg(F.coalesce(F.sum("qtd_pdvs"), F.lit(0)).alias("total_pdvs_validos"), F.count("*").alias("total_grupos"))
    one = totals.crossJoin(count(rejects, "total_pdvs_invalidos")).crossJoin(count(failures, "grupos_com_erro")).crossJoin(count(numbers, "total_rotas"))  # one row each
    went = F.col("total_grupos") - F.col("grupos_com_erro")
    rate = F.when(F.col("total_grupos") > 0, F.round(went / F.col("total_grupos") * 100, 1)).otherwise(0.0)
    metrics = durable(one.select("total_pdvs_validos", "total_pdvs_invalidos", "total_grupos", went.alias("grupos_processados"), "grupos_com_erro", "total_rotas", rate.alias("taxa_sucesso")))
    failed = F.col("grupos_com_erro") > 0
    status = metrics.select(F.when(failed & (F.col("grupos_processados") == 0), "partial_failed").when(failed, "done_with_warnings").otherwise("done").alias("status"), "total_grupos", "grupos_processados", "grupos_com_erro")
    return RouteRun(rejects, detail, summary, failures, metrics, status)
