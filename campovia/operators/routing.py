"""Routes: tours, leg costs, splitting of clusters, time windows, seller assignment, summaries."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions.geo import haversine_km
from campovia.operators import heuristics as h
from campovia.operators.reports import one_a_key, weighted_centre
from campovia.operators.territory import DEFAULTS, per_group

#: A leg under these is not believed (km, minutes); a route of fewer than two points takes so many minutes.
LEAST_KM, LEAST_MINUTES, LONE_MINUTES = 0.05, 0.05, 10.0


def tours(stops: DataFrame, route: list[str], key: str, lat: str, lon: str, slat: str, slon: str, improve: bool | str = False) -> DataFrame:
    """(route, key, seq): each route's visiting order from its start (slat, slon) to the nearest stop not visited yet.

    improve: 2-opt on the closed tour (True or "closed"), the best single reversal of the open path ("single"), or such reversals one
    after the other as long as they save more than a metre ("restart").
    """
    ways = {"closed": lambda xy, order, start: h.two_opt_closed(xy, order, start), "single": lambda xy, order, start: h.two_opt_single(xy, order), "restart": lambda xy, order, start: h.two_opt_restart(xy, order)}
    way = "closed" if improve is True else improve
    if way and way not in ways:
        raise ValueError(f"unknown improvement {way}; there are {', '.join(ways)}")

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        start = pdf[[slat, slon]].iloc[0].to_numpy(float)
        order = h.nearest_order(xy, start)
        order = ways[way](xy, order, start) if way else order
        out = pdf.iloc[order][[*route, key]].copy()
        out["seq"] = np.arange(1, len(out) + 1)
        return out

    kinds = ", ".join(f"{c} {stops.schema[c].dataType.simpleString()}" for c in [*route, key])
    return per_group(stops.select(*route, key, lat, lon, slat, slon), route, key, lat, lon, run, f"{kinds}, seq long")


def tour_costs(sequenced: DataFrame, route: list[str], seq: str, lat: str, lon: str, slat: str, slon: str, kmh: float, service: float, alpha: float) -> DataFrame:
    """(route, stops, km, minutes, km_partial, minutes_partial) of start, stops in order, start; partial leaves out the way back.

    Legs come from one window over the stop before; the way back is added at each route's last stop.
    """
    w = Window.partitionBy(*route).orderBy(seq)
    plat, plon = F.coalesce(F.lag(lat).over(w), F.col(slat)), F.coalesce(F.lag(lon).over(w), F.col(slon))
    leg = haversine_km(plat, plon, F.col(lat), F.col(lon))
    back = F.when(F.lead(seq).over(w).isNull(), haversine_km(F.col(lat), F.col(lon), F.col(slat), F.col(slon)))
    g = sequenced.withColumn("_leg", leg).withColumn("_back", back).groupBy(*route).agg(F.count("*").alias("stops"), (F.sum("_leg") * max(alpha, 1.0)).alias("_part"), (F.sum("_back") * max(alpha, 1.0)).alias("_home"))
    minutes = lambda km: F.round(km / max(kmh, 1e-6) * 60 + F.col("stops") * service, 1)
    whole = F.col("_part") + F.col("_home")
    return g.select(*route, "stops", F.round(whole, 2).alias("km"), minutes(whole).alias("minutes"), F.round("_part", 2).alias("km_partial"), minutes(F.col("_part")).alias("minutes_partial"))


def pair_costs(pairs: DataFrame, cache: DataFrame, providers: list[DataFrame], keys: list[str], here: tuple[str, str, str, str], alpha: float, kmh: float) -> DataFrame:
    """pairs with distancia_km, tempo_min, fonte: from the cache, else the first provider whose answer is believed, else great circle times alpha.

    cache and providers: (keys, km, minutes[, fonte]); of several answers for a key the shortest counts. Distances to 3, minutes to 1 decimal.
    """
    out = pairs
    steps = []
    for i, source in enumerate([cache, *providers]):
        name = "cache" if i == 0 else f"provider{i}"
        own = one_a_key(source, keys, [F.col("km").alias("km"), F.col("minutes").alias("minutes"), F.lit(name).alias("fonte")], f"_s{i}")
        out = out.join(own, keys, "left")
        believed = (F.col(f"_s{i}.km") >= LEAST_KM) & (F.col(f"_s{i}.minutes") >= LEAST_MINUTES)
        steps.append(F.when(believed, F.col(f"_s{i}")) if i else F.col(f"_s{i}"))
    km = haversine_km(*[F.col(c) for c in here]) * alpha
    best = F.coalesce(*steps, F.struct(km.alias("km"), (km / kmh * 60).alias("minutes"), F.lit("haversine").alias("fonte")))
    chosen = out.withColumn("_best", best)
    return chosen.select(*pairs.columns, F.round("_best.km", 3).alias("distancia_km"), F.round("_best.minutes", 1).alias("tempo_min"), F.col("_best.fonte").alias("fonte"))


def distance_matrix(points: DataFrame, group: str | list[str], key: str, lat: str, lon: str, alpha: float, kmh: float) -> DataFrame:
    """(group, i, j, km, minutes) for all pairs of each group: a matrix of one route, whose rows are the result itself."""
    keys = [group] if isinstance(group, str) else group
    a = points.select(*keys, F.col(key).alias("i"), F.col(lat).alias("alat"), F.col(lon).alias("alon"))
    b = points.select(*keys, F.col(key).alias("j"), F.col(lat).alias("blat"), F.col(lon).alias("blon"))
    km = haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")) * alpha
    return a.join(b, keys).select(*keys, "i", "j", F.round(km, 3).alias("km"), F.round(km / kmh * 60, 1).alias("minutes"))


def _routes(groups: list[np.ndarray], xy: np.ndarray, s: dict, improve: bool) -> list[tuple[np.ndarray, dict]]:
    return [(own, h.route(xy[own], xy[own].mean(0), s["kmh"], s["service"], s["alpha"], improve)) for own in groups]


def _kmeans_groups(xy: np.ndarray, k: int) -> list[np.ndarray]:
    labels, _ = h.kmeans(xy, k)
    return [np.flatnonzero(labels == j) for j in np.unique(labels)]


def split_fixed(xy: np.ndarray, visits: np.ndarray, s: dict) -> list[np.ndarray]:
    """Days by frequency, or by the sum of visits over the days."""
    k = math.ceil(visits.sum() / s["days"]) if s.get("count") == "proporcional" else max(1, int(s["days"] // max(s["freq"], 1)))
    return _kmeans_groups(xy, max(1, min(k, len(xy))))


def split_adaptive(xy: np.ndarray, visits: np.ndarray, s: dict) -> list[np.ndarray]:
    """One route for each day that the mean visit frequency leaves."""
    return _kmeans_groups(xy, max(1, min(int(s["days"] // max(visits.mean(), 1)), len(xy))))


#: The numbers of routes of an iterative split are tried in parts of their own, which begin at so many times the least number.
PARTS = (1.0, 1.4, 1.8, 2.2)


def split_iterative(xy: np.ndarray, visits: np.ndarray, s: dict, part: int | None = None) -> list[np.ndarray]:
    """One more route at a time until all are within the day and the distance. part: of the numbers of this part alone, and no groups if it is not the last one and none of them holds.

    Visits alone take their service time, so fewer routes than those that a day's most visits leave cannot hold and are not tried; a try ends at its first route that fails,
    the longest first. Where a single place has more visits than a day takes no number can hold, and the last one is made at once.
    """
    visits_a_day = max(1, int((s["day_minutes"] + 0.1) / s["service"])) if s["service"] > 0 else len(xy)
    least = max(1, min(len(xy), math.ceil(len(xy) / visits_a_day)))
    if len(xy) and h.places(xy)[2].max() > visits_a_day:
        least = len(xy)
    begin, end = (min(len(xy), math.ceil(least * PARTS[p])) if p is not None and p < len(PARTS) else None for p in (part, None if part is None else part + 1))
    begin, groups = begin or least, [np.arange(len(xy))]
    if end is not None and begin >= end:
        return []
    for k, labels in enumerate(h.kmeans_rising(xy, begin), begin):
        if k == end:
            return []
        groups = list(h._members(labels, np.unique(labels)).values())
        longest = sorted(groups, key=len, reverse=True)
        if len(longest[0]) <= visits_a_day and all(r["minutes"] <= s["day_minutes"] and r["km"] <= s["day_km"] for g in longest for _, r in _routes([g], xy, s, False)):
            return groups
    return groups if end is None else []


def split_capacity(xy: np.ndarray, visits: np.ndarray, s: dict) -> list[np.ndarray]:
    """As many routes as whole visit rounds fit in the period."""
    return _kmeans_groups(xy, max(1, min(int(math.floor(s["days"] / max(s["freq"], 1))), len(xy))))


def split_balanced(xy: np.ndarray, visits: np.ndarray, s: dict) -> list[np.ndarray]:
    """Routes between least and most stops: split, merge, spill and merge again."""
    by = {"frequencia": s["days"] // max(s["freq"], 1), "proporcional": math.ceil(visits.sum() / s["days"]), "capacidade": math.ceil(len(xy) / s["most"])}
    return h.balanced_groups(xy, max(1, min(int(by[s.get("count", "frequencia")]), len(xy))), s["least"], s["most"])


SPLITTERS: dict[str, Callable[[np.ndarray, np.ndarray, dict], list[np.ndarray]]] = {
    "fixo": split_fixed, "adaptativo": split_adaptive, "iterativo": split_iterative, "capacidade": split_capacity, "balanceado": split_balanced,
}


def split_routes(stops: DataFrame, cluster: list[str], key: str, lat: str, lon: str, mode: str, visits: str | None = None, improve: bool = False, **settings) -> DataFrame:
    """(cluster, rota, seq, key, n_pdvs, km, minutes, status): each cluster split into daily routes by mode, with visiting order and cost.

    A cluster whose routes cannot be made gets one row a stop with status "erro: ..." and no route; the others go on. The numbers of routes that the mode iterativo tries are cut into
    parts, each a task of its own; of a cluster's parts the first that holds counts.
    """
    if mode not in SPLITTERS:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(SPLITTERS)}")
    s = DEFAULTS | {"alpha": 1.3, "least": 8, "most": 12} | settings
    columns = [*cluster, key, lat, lon, *([visits] if visits else [])]
    named = [*cluster, "rota", "seq", key, "n_pdvs", "km", "minutes", "status"]

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        try:
            frequency = pdf[visits].fillna(1).to_numpy(float) if visits else np.ones(len(xy))
            groups = SPLITTERS[mode](xy, frequency, s, int(pdf["_part"].iloc[0])) if mode == "iterativo" else SPLITTERS[mode](xy, frequency, s)
            parts = [pdf[[*cluster, key]].head(0).assign(rota=0, seq=0, n_pdvs=0, km=0.0, minutes=0.0, status="")]
            for r, (own, cost) in enumerate(_routes(groups, xy, s, improve), 1):
                part = pdf.iloc[own[cost["order"]]][[*cluster, key]].copy()
                fits = cost["minutes"] <= s["day_minutes"] and cost["km"] <= s["day_km"]
                parts.append(part.assign(rota=r, seq=np.arange(1, len(part) + 1), n_pdvs=len(part), km=cost["km"], minutes=cost["minutes"], status="OK" if fits else "EXCEDIDO"))
            out = pd.concat(parts[1:] or parts)[named]
        except (ValueError, ArithmeticError) as error:  # one group of bad data must not end the others
            out = pdf[[*cluster, key]].assign(rota=None, seq=None, n_pdvs=len(pdf), km=np.nan, minutes=np.nan, status=f"erro: {error}")[named]
        return out.assign(_part=pdf["_part"].iloc[0]) if mode == "iterativo" else out

    kinds = {c: stops.schema[c].dataType.simpleString() for c in [*cluster, key]}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cluster), "rota long", "seq long", f"{key} {kinds[key]}", "n_pdvs long", "km double", "minutes double", "status string"])
    if mode != "iterativo":
        return per_group(stops.select(*columns), cluster, key, lat, lon, run, schema)
    rows = stops.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(len(PARTS) - 1))).alias("_part"))
    tried = per_group(rows, [*cluster, "_part"], key, lat, lon, run, f"{schema}, _part int", tasks=512)
    return tried.withColumn("_first", F.min("_part").over(Window.partitionBy(*cluster))).where("_part = _first").select(*named)


def run_status(routes: DataFrame) -> DataFrame:
    """(status): done, done_with_warnings if some route is over its limits or some group failed, partial_failed if every group did. A whole run with its outputs is in runs.py."""
    failed, over = F.col("status").startswith("erro"), F.col("status") == "EXCEDIDO"
    all_failed, some = F.bool_and(failed), F.bool_or(failed | over)
    return routes.agg(F.when(all_failed, "partial_failed").when(some, "done_with_warnings").otherwise("done").alias("status"))


def time_window_routes(stops: DataFrame, cluster: str, key: str, lat: str, lon: str, opens: str, closes: str, service: str, strategic: str, capacity: int = 12, strategic_capacity: int = 4, day: tuple[float, float] = (480.0, 1080.0), kmh: float = 35.0, alpha: float = 1.3, strategic_minutes: float = math.inf, strict: bool = False, relaxed: bool = False) -> DataFrame:
    """(cluster, key, rota, seq, chegada, saida, status): routes within opening times, with when service begins and ends at each stop.

    viavel_sla where a route's windows hold, else fallback_excedente: with relaxed a stop that no strict route can serve is put in a route with open
    windows and a longer day, without it such stops come without a route. Missing windows are the whole day, or with strict an error;
    missing service times are 30 minutes. A stop counts as strategic too if its service takes strategic_minutes or more.
    """
    if strict and not stops.where(F.col(opens).isNull() | F.col(closes).isNull()).isEmpty():
        raise ValueError("a stop has no time window")

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        minutes = pdf[service].fillna(30.0).to_numpy(float)
        found = h.time_window_routes(
            xy, xy.mean(0), pdf[opens].fillna(day[0]).to_numpy(float), pdf[closes].fillna(day[1]).to_numpy(float), minutes,
            pdf[strategic].fillna(False).to_numpy(bool) | (minutes >= strategic_minutes), capacity, strategic_capacity, day, kmh, alpha, relaxed,
        )
        status = {False: "viavel_sla", True: "fallback_excedente"}
        laid = enumerate(zip(found["routes"], found["times"], found["fallback"]), 1)
        rows = [(p, r, i, t, t + minutes[p], status[beyond]) for r, (own, times, beyond) in laid for i, (p, t) in enumerate(zip(own, times), 1)]
        rows += [(p, None, None, None, None, "fallback_excedente") for p in found["dropped"]]
        out = pd.DataFrame(rows, columns=["i", "rota", "seq", "chegada", "saida", "status"])
        out.insert(0, key, pdf[key].to_numpy()[out["i"].to_numpy(int)])
        out.insert(0, cluster, pdf[cluster].iloc[0])
        return out.drop(columns="i")

    kinds = {c: stops.schema[c].dataType.simpleString() for c in (cluster, key)}
    return per_group(stops.select(cluster, key, lat, lon, opens, closes, service, strategic), [cluster], key, lat, lon, run, f"{cluster} {kinds[cluster]}, {key} {kinds[key]}, rota long, seq long, chegada double, saida double, status string")


def assign_sellers(routes: DataFrame, group: str, key: str, lat: str, lon: str, days: int, freq: int) -> DataFrame:
    """routes with vendedor_id from 1 in each group: by longitude, then latitude, round(days / freq) routes (halves to even) to a seller."""
    capacity = max(1, int(round(days / max(freq, 1))))
    pos = F.row_number().over(Window.partitionBy(group).orderBy(lon, lat, key)) - 1
    return routes.withColumn("vendedor_id", (F.floor(pos / capacity) + 1).cast("long"))


def seller_bases(routes: DataFrame, stops: DataFrame, seller: list[str], lat: str, lon: str, weight: str, key: str, place: list[str]) -> DataFrame:
    """(seller, lat, lon, place): the weighted mean of a seller's routes, and the place of the seller's stop nearest to it."""
    centre = weighted_centre(routes.withColumn("_s", F.struct(*seller)), "_s", lat, lon, weight).select(*[F.col(f"_s.{c}").alias(c) for c in seller], F.col(lat).alias("base_lat"), F.col(lon).alias("base_lon"))
    km = haversine_km(F.col("base_lat"), F.col("base_lon"), F.col(lat), F.col(lon))
    near = stops.join(centre, seller).groupBy(*seller, "base_lat", "base_lon").agg(F.min(F.struct(F.round(km, 9).alias("km"), F.col(key), *place)).alias("b"))
    return near.select(*seller, "base_lat", "base_lon", *[F.col(f"b.{c}").alias(c) for c in place])


def usable_lines(routes: DataFrame, points: str) -> DataFrame:
    """Routes whose line has at least two points."""
    return routes.where(F.size(points) >= 2)
