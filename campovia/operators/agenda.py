"""Schedules: routes laid on working days, visits, itineraries, backlog and status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions.dates import effective_date, effective_status
from campovia.operators.reports import natural_number

DONE = "realizada"


def schedule(routes: DataFrame, days: DataFrame, consultant: str | list[str], route: str) -> DataFrame:
    """routes with data: a consultant's i-th route, in natural order of its name, on the i-th working day (days: day, nth).

    A consultant with more routes than the period has days is an error.
    """
    nth = F.row_number().over(Window.partitionBy(consultant).orderBy(natural_number(F.col(route)), route))
    placed = routes.withColumn("nth", nth).join(days.withColumnRenamed("day", "data"), "nth", "left")
    short = placed.where("data IS NULL").agg(F.max("nth")).first()[0]
    if short is not None:
        raise ValueError(f"the period has fewer than {short} working days")
    return placed.drop("nth")


def visits_flat(visits: DataFrame, today: Column, planned: str = "data_prevista", date: str = "data", status: str = "status") -> DataFrame:
    """visits with data_efetiva and status_efetivo."""
    day = effective_date(F.col(planned), F.col(date))
    return visits.withColumn("data_efetiva", day).withColumn("status_efetivo", effective_status(F.col(status), day, today))


def agenda_counts(visits: DataFrame, agenda: str, route: str, consultant: str, status: str) -> DataFrame:
    """Each agenda's distinct routes and consultants, visits and visits done."""
    return visits.groupBy(agenda).agg(
        F.countDistinct(route).alias("rotas"), F.countDistinct(consultant).alias("consultores"), F.count("*").alias("visitas"), F.count(F.when(F.col(status) == DONE, 1)).alias("realizadas")
    )


def itinerary(visits: DataFrame, consultant: str, date: str, seq: str, columns: list[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(consultant, dias): an array of days, each with its visits in order."""
    period = F.lit(True)
    period = period if first is None else period & (F.col(date) >= first)
    period = period if last is None else period & (F.col(date) <= last)
    day = visits.where(period).groupBy(consultant, date).agg(F.array_sort(F.collect_list(F.struct(seq, *columns))).alias("visitas"))
    return day.groupBy(consultant).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("data"), "visitas"))).alias("dias"))


def backlog(visits: DataFrame, status: str, planned: str, date: str, key: str) -> DataFrame:
    """Visits not done, by effective date."""
    return visits.where(F.col(status) != DONE).withColumn("data_efetiva", effective_date(F.col(planned), F.col(date))).orderBy("data_efetiva", key)


def occupied_days(visits: DataFrame, consultant: str, date: str) -> DataFrame:
    """The days on which a consultant has a route."""
    return visits.select(consultant, date).where(F.col(date).isNotNull()).distinct()


def change_visits(visits: DataFrame, key: str, changes: DataFrame, columns: list[str]) -> DataFrame:
    """visits with the columns that changes (unique keys) give; a null there leaves the old value."""
    given = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = visits.join(given, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*visits.columns)


def move_route(routes: DataFrame, hit: Column, date: Column) -> DataFrame:
    """Routes set on another date by hand, marked as such."""
    hit = F.coalesce(hit, F.lit(False))
    return routes.withColumn("data", F.when(hit, date).otherwise(F.col("data"))).withColumn("manual", F.when(hit, True).otherwise(F.col("manual")))


def from_routing(routes: DataFrame, sectors: DataFrame, stops: DataFrame, pdvs: DataFrame) -> DataFrame:
    """(consultor, rota, paradas) of a stored routing.

    routes: (cluster, seq); sectors: (cluster, consultor, label); stops: (cluster, seq, ordem, pdv); pdvs: (pdv, nome). A sector without
    consultant is "Setor n"; a route is R and its number, unique together with its cluster; stops without a listed pdv stay.
    """
    named = routes.join(sectors, "cluster").withColumn("consultor", F.coalesce("consultor", F.concat(F.lit("Setor "), F.col("label").cast("string"))))
    lines = stops.join(pdvs, "pdv", "left").groupBy("cluster", "seq").agg(F.array_sort(F.collect_list(F.struct("ordem", "pdv", "nome"))).alias("paradas"))
    return named.join(lines, ["cluster", "seq"]).select("consultor", "cluster", F.concat(F.lit("R"), F.col("seq").cast("string")).alias("rota"), "paradas")
