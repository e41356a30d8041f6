"""The whole clustering run by names: algorithms, refinement modes and parameters, from Python or from SQL."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.operators import heuristics as h
from campovia.operators import territory
from campovia.operators.spatial import flag_outliers
from campovia.session import durable

#: Points of a run (a group) at most, unless the caller says otherwise: sequential algorithms have a group in one task.
RUN_POINTS = 3000
ALGORITHMS = ("capacitated_sweep", "consultor_nearest", "dense_subset", "kmeans")
MODES = ("capacidade", "fixo", "operacional")
# Names under which the coordinates of a table are known.
LATITUDES, LONGITUDES = ("latitude", "lat", "lat_pdv", "lat_entrega"), ("longitude", "lon", "lng", "long", "long_pdv", "lng_pdv")


@dataclass(frozen=True)
class Settings:
    """A run's parameters by their public names. Numbers that must be positive are listed in POSITIVE."""

    algoritmo: str = "kmeans"
    sheet_name: str | None = None
    consultor_prefix: str = "Consultor"
    latitude_col: str | None = None
    longitude_col: str | None = None
    random_state: int = 42
    max_pdv_cluster: int = 200
    dias_uteis: int = 20
    freq: int = 1
    workday_min: float = 500
    route_km_max: float = 200.0
    service_min: float = 30
    v_kmh: float = 35.0
    alpha_path: float = 1.4
    max_iter: int = 10
    excluir_outliers: bool = False
    z_thresh: float = 3.0
    k_forcado: int | None = None
    consultores: tuple[tuple[str, float, float], ...] | None = None
    permitir_excedente: bool = True
    modo_refinamento: str = "capacidade"
    min_pdv_cluster: int | None = None


POSITIVE = "max_pdv_cluster dias_uteis freq workday_min route_km_max service_min v_kmh alpha_path max_iter z_thresh".split()


def settings(raw: Mapping[str, Any] | None = None, algorithm: str | None = None) -> Settings:
    """Settings from named values; unknown names are ignored, algo and n_clusters are other names for algoritmo and k_forcado, sweep one for capacitated_sweep.

    n_clusters also lifts the capacity, so that the number of clusters holds. An unknown algorithm or mode, a number that is not positive and a
    consultant list that consultor_nearest lacks are errors.
    """
    given = {k: v for k, v in dict(raw or {}).items() if v is not None}
    given["algoritmo"] = str(algorithm or given.get("algoritmo") or given.get("algo") or "kmeans").lower().strip()
    if given["algoritmo"] == "sweep":
        given["algoritmo"] = "capacitated_sweep"
    if "n_clusters" in given and "max_pdv_cluster" not in given:
        given["k_forcado"] = max(1, int(given["n_clusters"]))
        given["max_pdv_cluster"] = math.ceil(10**9 / given["k_forcado"])
    if "consultores" in given:
        given["consultores"] = tuple((str(c["nome"]), float(c["lat"]), float(c["lon"])) if isinstance(c, Mapping) else tuple(c) for c in given["consultores"])
    s = Settings(**{f.name: given[f.name] for f in fields(Settings) if f.name in given})
    for name, value, known in (("algoritmo", s.algoritmo, ALGORITHMS), ("modo_refinamento", s.modo_refinamento, MODES)):
        if value not in known:
            raise ValueError(f"{name} is none of {', '.join(known)}: {value}")
    for name in POSITIVE:
        if getattr(s, name) <= 0:
            raise ValueError(f"{name} must be positive")
    if s.algoritmo == "consultor_nearest" and not s.consultores:
        raise ValueError("consultor_nearest needs consultores")
    if s.algoritmo == "kmeans" and s.modo_refinamento == "fixo" and (s.k_forcado or 0) < 1:
        raise ValueError("mode fixo needs k_forcado")
    return s


def start_k(n: int, s: Settings) -> int:
    """Clusters to begin with."""
    return s.k_forcado or max(1, math.ceil(n / (s.max_pdv_cluster * s.freq)))


def labels_of(xy: np.ndarray, s: Settings) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(labels, names, status) of one group's points, for callers that have a group at hand; `run` gives the same for tables."""
    if s.algoritmo == "consultor_nearest":
        where = np.array([c[1:] for c in s.consultores], float)
        labels, over = h.greedy_nearest(h.km_matrix(xy, where), s.max_pdv_cluster, s.permitir_excedente)
        return labels, [s.consultores[j][0] for j in labels], np.where(over, "EXCEDENTE", "OK")
    if s.algoritmo == "capacitated_sweep":
        mean = xy.mean(axis=0)
        order = np.lexsort((np.arange(len(xy)), h.km_matrix(xy, mean[None])[:, 0], bearings(xy, mean)))
        labels = np.empty(len(xy), np.int64)
        labels[order] = np.arange(len(xy)) // s.max_pdv_cluster
    elif s.algoritmo == "dense_subset":
        total = np.round(h.km_matrix(xy, xy).sum(axis=1), 6)
        order = np.lexsort((np.arange(len(xy)), np.round(h.km_matrix(xy, xy[[total.argmin()]])[:, 0], 9)))
        labels = np.ones(len(xy), np.int64)
        labels[order[: s.max_pdv_cluster]] = 0
    elif s.modo_refinamento == "fixo":
        labels = h.kmeans(xy, s.k_forcado, s.random_state)[0]
    else:
        labels = h.balanced(xy, s.max_pdv_cluster, s.modo_refinamento == "capacidade", start_k(len(xy), s), s.random_state)
        if s.modo_refinamento == "operacional":
            labels = h.refine(xy, int(labels.max()) + 1, s.dias_uteis, s.freq, s.workday_min, s.route_km_max, s.v_kmh, s.service_min, s.alpha_path, s.max_iter)[0]
    status = np.full(len(xy), "OK", object)
    if s.algoritmo == "kmeans":
        labels, status = h.within_band(xy, labels, s.min_pdv_cluster, s.max_pdv_cluster if s.min_pdv_cluster or s.modo_refinamento == "fixo" else None, s.modo_refinamento)
    return labels, [f"{s.consultor_prefix} {j + 1}" for j in labels], status


def bearings(xy: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Initial courses from the mean point, 0 to 2 pi."""
    lat, (mlat, _) = np.radians(xy[:, 0]), np.radians(mean)
    d = np.radians(xy[:, 1] - mean[1])
    angle = np.arctan2(np.sin(d) * np.cos(lat), np.cos(mlat) * np.sin(lat) - np.sin(mlat) * np.cos(lat) * np.cos(d))
    return np.where(angle < 0, angle + 2 * np.pi, angle)


def operational(df: DataFrame, group: str, key: str, lat: str, lon: str, starts: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(labels, routes) of the operational mode: labels (group, key, label, rounds), routes (group, label, day, points, km, minutes, ok).

    Rounds over the groups that still fail: each is cut into k clusters, every cluster's days are routed, a cluster a task; groups
    whose days all hold are done and leave, the others go on with one cluster more, max_iter rounds at most, and keep their last try. starts: (group, k).
    Each round is written, so that a later one reads what it needs and no more.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    open_ = durable(df.select(group, key, lat, lon).join(starts, group))
    done: list[tuple[DataFrame, DataFrame]] = []
    for step in range(s.max_iter):

        def cut(pdf: pd.DataFrame, xy: np.ndarray, step: int = step) -> pd.DataFrame:
            labels = np.unique(h.kmeans(xy, int(pdf["k"].iloc[0]) + step, h.SEED)[0], return_inverse=True)[1]
            return pd.DataFrame({group: pdf[group], key: pdf[key], "label": labels})

        def days(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
            day, centres = h.kmeans(xy, min(max(1, int(s.dias_uteis / max(s.freq, 1))), len(xy)), h.SEED)
            rows = []
            for d in np.unique(day):
                r = h.route(xy[day == d], centres[d], s.v_kmh, s.service_min, s.alpha_path)
                rows.append((int(d) + 1, int((day == d).sum()), r["km"], r["minutes"], bool(r["minutes"] <= s.workday_min and r["km"] <= s.route_km_max)))
            out = pd.DataFrame(rows, columns=["day", "points", "km", "minutes", "ok"])
            out.insert(0, "label", pdf["label"].iloc[0])
            out.insert(0, group, pdf[group].iloc[0])
            return out

        labels = durable(territory.per_group(open_, [group], key, lat, lon, cut, f"{group} {kinds[group]}, {key} {kinds[key]}, label long"))
        placed = open_.join(labels, [group, key])
        routes = durable(territory.per_group(placed, [group, "label"], key, lat, lon, days, f"{group} {kinds[group]}, label long, day long, points long, km double, minutes double, ok boolean"))
        held = routes.groupBy(group).agg(F.bool_and("ok").alias("all_ok"))
        ready = held if step == s.max_iter - 1 else held.where("all_ok")
        done.append((labels.join(ready.select(group), group, "left_semi").withColumn("rounds", F.lit(step + 1)), routes.join(ready.select(group), group, "left_semi")))
        open_ = durable(open_.join(ready.select(group), group, "left_anti"))
        if open_.isEmpty():
            break
    whole, kept = done[0]
    for more, others in done[1:]:
        whole, kept = whole.unionByName(more), kept.unionByName(others)
    return whole, kept


def run(df: DataFrame, group: str, key: str, raw: Mapping[str, Any] | Settings | None = None, limit: int | None = RUN_POINTS) -> DataFrame:
    """(group, key, label, consultor, banda_status): the whole run. A group is a run of its own: a state, a city, an input.

    raw: settings by name (`settings`). The coordinates' columns are latitude_col and longitude_col, or the first that is known by a usual
    name. More than limit rows in a group are an error (None: no limit). Of rows that share a key one stays. With excluir_outliers, points far from all others leave.
    Labels count from 0 in each group. Clusters of k-means are brought within the band if min_pdv_cluster is given; fixo only judges. Rows without
    coordinates keep a row, without label, SEM_COORDENADAS.
    """
    s = raw if isinstance(raw, Settings) else settings(raw)
    named = {c.strip().lower(): c for c in reversed(df.columns)}
    lat, lon = (own if own in df.columns else next((named[n] for n in usual if n in named), None) for own, usual in ((s.latitude_col, LATITUDES), (s.longitude_col, LONGITUDES)))
    if lat is None or lon is None:
        raise ValueError("no columns of coordinates")
    crowded = df.groupBy(group).count().where(F.col("count") > limit).limit(10).collect() if limit is not None else []
    if crowded:
        raise ValueError(f"more than {limit} points in {', '.join(str(r[0]) for r in crowded)}")
    rows = durable(df.select(group, key, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropDuplicates([key]))
    nowhere = rows.where("lat IS NULL OR lon IS NULL OR isnan(lat) OR isnan(lon)").select(group, key, F.lit(None).cast("long").alias("label"), F.lit(None).cast("string").alias("consultor"), F.lit("SEM_COORDENADAS").alias("banda_status"))
    kept = rows.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    if s.excluir_outliers:
        kept = durable(flag_outliers(kept, key, "lat", "lon", s.z_thresh).where("NOT is_outlier").select(group, key, "lat", "lon"))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    if s.algoritmo == "capacitated_sweep":
        labels = territory.sweep(kept, group, key, "lat", "lon", s.max_pdv_cluster).select(group, key, "label", F.lit("OK").alias("banda_status"))
    elif s.algoritmo == "dense_subset":
        labels = territory.dense_subset(kept, group, key, "lat", "lon", s.max_pdv_cluster).select(group, key, F.when(F.col("dentro"), 0).otherwise(1).cast("long").alias("label"), F.lit("OK").alias("banda_status"))
    elif s.algoritmo == "kmeans" and s.modo_refinamento == "operacional":

        def count(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
            first = h.balanced(xy, s.max_pdv_cluster, False, start_k(len(xy), s), s.random_state)
            return pd.DataFrame({group: [pdf[group].iloc[0]], "k": [int(first.max()) + 1]})

        starts = durable(territory.per_group(kept, [group], key, "lat", "lon", count, f"{group} {kinds[group]}, k int"))
        found = operational(kept, group, key, "lat", "lon", starts, s)[0]
        labels = territory.rebalanced(kept.join(found, [group, key]), group, key, "lat", "lon", "label", s.min_pdv_cluster, s.max_pdv_cluster if s.min_pdv_cluster else None)
    else:

        def place(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
            found, names, status = labels_of(xy, s)
            return pd.DataFrame({group: pdf[group], key: pdf[key], "label": found, "consultor": names, "banda_status": status})

        labels = territory.per_group(kept, [group], key, "lat", "lon", place, f"{group} {kinds[group]}, {key} {kinds[key]}, label long, consultor string, banda_status string")
    if "consultor" not in labels.columns:
        labels = labels.withColumn("consultor", F.concat_ws(" ", F.lit(s.consultor_prefix), (F.col("label") + 1).cast("string")))
    return labels.select(group, key, "label", "consultor", "banda_status").unionByName(nowhere)


def as_dict(s: Settings) -> dict[str, Any]:
    """Settings by name."""
    return asdict(s)
