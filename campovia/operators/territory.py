"""Territories: outliers, cluster counts, sweeps, medoid subsets, assignment, bands, refinement, and the pipeline over all."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions.geo import bearing, haversine_km, planar_sq
from campovia.operators import heuristics as h
from campovia.operators import reports
from campovia.operators.filters import guard_size
from campovia.operators.nearest import nearest_centre
from campovia.operators.spatial import flag_outliers
from campovia.session import durable

#: Consultants of a short list at most.
CENTRE_BLOCK = 2000
#: Points of a block of which distance matrices are made.
MEDOID_BLOCK = 1000
#: Pairs of places, and places to measure in each group, up to which a medoid is searched among all.
MEDOID_PAIRS, MEDOID_FEW = 20_000_000, 400
#: Usual settings: working days, visits a period, minutes a day, km a route, minutes a stop, km/h, road factor, rounds, outlier bar.
DEFAULTS = {"days": 20, "freq": 1, "day_minutes": 600.0, "day_km": 200.0, "service": 30.0, "kmh": 35.0, "alpha": 1.4, "rounds": 10, "z": 3.0}


def estimated_k(n: Column, most: int, freq: int = 1) -> Column:
    """Clusters for n points at a capacity times the visit frequency, at least 1."""
    return F.greatest(F.lit(1), F.ceil(n / (most * max(freq, 1)))).cast("int")


def k_by_radius(df: DataFrame, group: str, lat: str, lon: str, radius_km: float = 5.0) -> DataFrame:
    """(group, k): circles of the radius that the group's area takes, by the 95th percentile of the distance from its mean point."""
    mean = df.groupBy(group).agg(F.avg(lat).alias("mlat"), F.avg(lon).alias("mlon"))
    away = df.join(mean, group).withColumn("km", haversine_km(F.col("mlat"), F.col("mlon"), F.col(lat), F.col(lon)))
    g = away.groupBy(group).agg(F.count("*").alias("n"), F.percentile("km", 0.95).alias("p95"))
    k = F.ceil(F.col("n") / (F.col("n") / (F.pi() * F.col("p95") * F.col("p95")) * (math.pi * radius_km**2)))
    return g.select(group, F.when(F.col("n") < 2, 1).otherwise(F.greatest(F.lit(1), F.coalesce(k, F.lit(1)))).cast("int").alias("k"))


def per_group(df: DataFrame, group: list[str], key: str, lat: str, lon: str, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, tasks: int = 1) -> DataFrame:
    """fn(rows in order of key, their coordinates) for each group, one task's worth at a time; rows without coordinates are left out.

    Sequential algorithms need their group in one place: a group is a territory or a route, not a table. tasks: how many there are at least, so that few groups of long
    work do not meet in one.
    """
    # Small rows, long work: a fixed number of partitions keeps groups from being gathered in few tasks for their size.
    parts = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).repartition(parts, *group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        return fn(pdf, pdf[[lat, lon]].to_numpy(float))

    return rows.groupBy(*group).applyInPandas(run, schema)


def labelled(df: DataFrame, group: str, key: str, lat: str, lon: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(group, key, label): labels of a group's points by a function of their coordinates."""

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({group: pdf[group], key: pdf[key], "label": fn(xy).astype("int64")})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    return per_group(df.select(group, key, lat, lon), [group], key, lat, lon, run, f"{group} {kinds[group]}, {key} {kinds[key]}, label long")


def _groups_to_labels(groups: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for j, own in enumerate(groups):
        out[own] = j
    return out


def kmeans_labels(df: DataFrame, group: str, key: str, lat: str, lon: str, k: int) -> DataFrame:
    """k-means within each group, k between 1 and the number of different points."""
    return labelled(df, group, key, lat, lon, lambda xy: h.kmeans(xy, k)[0])


def balanced_kmeans(df: DataFrame, group: str, key: str, lat: str, lon: str, most: int, spread: bool = False) -> DataFrame:
    """k-means with ceil(n / most) clusters, border points optionally spread to neighbours with room, and what is still over `most` split."""

    return labelled(df, group, key, lat, lon, lambda xy: h.balanced(xy, most, spread))


def feature_kmeans(df: DataFrame, group: str, key: str, features: list[str], most: int) -> DataFrame:
    """k-means on standardised features, gaps filled with the median, with ceil(n / most) clusters, then split by `most`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        x = pdf[features].astype(float)
        x = x.fillna(x.median()).fillna(0.0).to_numpy()
        std = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(std > 0, std, 1)
        labels, _ = h.kmeans(x, max(1, math.ceil(len(x) / most)))
        parts = [own[i : i + most] for own in (np.flatnonzero(labels == j) for j in np.unique(labels)) for i in range(0, len(own), most)]
        return pd.DataFrame({group: pdf[group], key: pdf[key], "label": _groups_to_labels(parts, len(x))})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    return df.select(group, key, *features).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, label long")


def dbscan_labels(df: DataFrame, group: str, key: str, lat: str, lon: str, eps_km: float | None = None, least: int | None = None, bounds: tuple = (2.0, 6.0, 10, 30)) -> DataFrame:
    """Density clusters within each group; radius and core size follow the median nearest distance; noise joins the nearest cluster's centre."""
    low, high, few, many = bounds

    def run(xy: np.ndarray) -> np.ndarray:
        n = len(xy)
        if n < 2:
            return np.zeros(n, np.int64)
        typical = 0.0
        if eps_km is None or least is None:  # nothing else asks for it
            nearest = np.empty(n)
            for i in range(n):
                d = h.km_matrix(xy[[i]], xy)[0]
                d = d[d > 0]
                nearest[i] = d.min() if len(d) else 0.0
            typical = float(np.median(nearest))
        eps = (eps_km if eps_km is not None else float(np.clip(typical * 20, low, high))) / 111.0
        core = least
        if core is None:
            core = max(3, min(30, n // 2)) if n < 60 else int(np.clip(int(few + np.clip((1 / (typical + 1e-6) - 0.05) / 0.1, 0, 1) * (many - few)), few, many))
        labels = h.dbscan(xy, eps, core)
        if labels.max() < 0:
            return np.zeros(n, np.int64)
        clusters = h._members(labels[labels >= 0], np.arange(labels.max() + 1))
        held = np.flatnonzero(labels >= 0)
        centres = np.array([xy[held[own]].mean(0) for own in clusters.values()])
        noise = np.flatnonzero(labels < 0)
        rows = max(1, 1_000_000 // len(centres))
        for i in range(0, len(noise), rows):
            labels[noise[i : i + rows]] = h.km_matrix(xy[noise[i : i + rows]], centres).argmin(1)
        return labels

    return labelled(df, group, key, lat, lon, run)


def sweep(df: DataFrame, group: str, key: str, lat: str, lon: str, capacity: int, planar: bool = False) -> DataFrame:
    """df with label: points by bearing from their group's mean point, then by distance, then by key, cut into runs of capacity."""
    mean = df.groupBy(group).agg(F.avg(lat).alias("_mlat"), F.avg(lon).alias("_mlon"))
    here = [F.col(c) for c in (lat, lon, "_mlat", "_mlon")]
    if planar:
        angle, away = F.atan2(here[0] - here[2], here[1] - here[3]), planar_sq(*here)
    else:
        angle, away = bearing(*here), haversine_km(*here)
    order = Window.partitionBy(group).orderBy("_angle", "_away", key)
    placed = df.join(mean, group).withColumn("_angle", angle).withColumn("_away", away)
    return placed.withColumn("label", F.floor((F.row_number().over(order) - 1) / capacity).cast("long")).select(*df.columns, "label")


def medoid(df: DataFrame, group: str, key: str, lat: str, lon: str) -> DataFrame:
    """(group, medoid, mlat, mlon): the point of least distance to all others of its group; ties go to the smaller key.

    Points of one place are one of their number and of the smallest key. Where there are many pairs of places, those that cannot be the medoid are left out first, round by round:
    the sum of distances grows from any place at least as its slope there tells, so a few measured places around the best one rule out nearly all others. The sums of what is left are
    taken over all places, in pairs of blocks of at most about MEDOID_BLOCK: no pair of points becomes a row and no group, however large, one task. Where hardly a
    place can be ruled out (all on a circle, say) the work stays that of all pairs. The places are written once, for they are read several times.
    """
    places = durable(df.groupBy(group, lat, lon).agg(F.min(key).alias(key), F.count("*").cast("double").alias("_copies")))
    known = (F.abs(lat) <= 90) & (F.abs(lon) < math.inf)
    sizes = places.groupBy(group).agg(
        F.count("*").alias("_n"), F.sum("_copies").alias("_weight"), F.bool_and(F.coalesce(known, F.lit(False))).alias("_known"),
        (F.sum(F.col(lat) * F.col("_copies")) / F.sum("_copies")).alias("_clat"), (F.sum(F.col(lon) * F.col("_copies")) / F.sum("_copies")).alias("_clon"),
    )
    total, pairs = sizes.agg(F.sum("_n"), F.sum(F.col("_n").cast("double") * F.col("_n"))).first()
    live, centre = places, sizes.where("_known").select(group, "_clat", "_clon")
    while pairs and pairs > max(MEDOID_PAIRS, MEDOID_FEW * total):
        live, centre = _medoid_round(live, places, sizes, centre, group, key, lat, lon)
        left = live.groupBy(group).agg(F.count("*").alias("_live")).join(sizes, group).agg(F.sum(F.col("_live").cast("double") * F.col("_n"))).first()[0] or 0
        pairs, before = left, pairs
        if left > before / 2:
            break
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total = (h.km_matrix(a[[lat, lon]].to_numpy(float), b[["_lat", "_lon"]].to_numpy(float)) * b["_weight"].to_numpy()).sum(axis=1) if len(a) else []
        return a[[group, key, lat, lon]].assign(km=total)

    parts = _in_blocks(live.select(group, key, lat, lon), places, group, key, lat, lon).applyInPandas(sums, f"{group} {kinds[group]}, {key} {kinds[key]}, {lat} double, {lon} double, km double")
    whole = parts.groupBy(group, key, lat, lon).agg(F.round(F.sum("km"), 6).alias("sum"))
    best = whole.groupBy(group).agg(F.min(F.struct("sum", key, lat, lon)).alias("b"))
    return best.select(group, F.col(f"b.{key}").alias("medoid"), F.col(f"b.{lat}").alias("mlat"), F.col(f"b.{lon}").alias("mlon"))


def _in_blocks(rows: DataFrame, places: DataFrame, group: str, key: str, lat: str, lon: str):
    """Every block of a group's rows with every block of its places: (rows; _lat, _lon, _weight) to be taken together."""
    blocks = lambda df, name: df.groupBy(group).agg(F.ceil(F.count("*") / MEDOID_BLOCK).cast("long").alias(name))
    sizes = blocks(rows, "_is").join(blocks(places, "_js"), group)
    own = lambda n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(sizes, group).withColumn("_i", own("_is")).withColumn("_j", every("_js")).drop("_is", "_js")
    right = places.join(sizes, group).withColumn("_b", own("_js")).withColumn("_a", every("_is"))
    right = right.select(F.col(group).alias("_g"), "_a", "_b", F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.col("_copies").alias("_weight"))
    return left.groupBy(group, "_i", "_j").cogroup(right.groupBy("_g", "_a", "_b"))


def _medoid_round(live: DataFrame, places: DataFrame, sizes: DataFrame, centre: DataFrame, group: str, key: str, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """(the live places that may still be their group's medoid, the best place measured as the next centre).

    Of each of 16 directions and each doubling of the distance from the centre the nearest live place is measured. Groups with coordinates that are none keep all their places.
    """
    away = haversine_km(F.col("_clat"), F.col("_clon"), F.col(lat), F.col(lon))
    placed = live.join(centre, group).withColumn("_km", away)
    sector = F.floor(bearing(F.col(lat), F.col(lon), F.col("_clat"), F.col("_clon")) / (math.pi / 8))
    octave = F.floor(F.log2(F.greatest(F.col("_km"), F.lit(0.001))))
    picked = placed.groupBy(group, sector.alias("_sector"), octave.alias("_octave")).agg(F.min(F.struct("_km", key, lat, lon)).alias("_p")).select(group, f"_p.{key}", f"_p.{lat}", f"_p.{lon}")
    kinds = {c: live.schema[c].dataType.simpleString() for c in (group, key)}
    found = ["km", "east", "north", "steady", "loss"]

    def slopes(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = h.distance_slopes(a[[lat, lon]].to_numpy(float), b[["_lat", "_lon"]].to_numpy(float), b["_weight"].to_numpy(float)) if len(a) else [[]] * 5
        return a[[group, key, lat, lon]].assign(**dict(zip(found, made)))

    parts = _in_blocks(durable(picked), places, group, key, lat, lon).applyInPandas(slopes, f"{group} {kinds[group]}, {key} {kinds[key]}, {lat} double, {lon} double, " + ", ".join(f"{c} double" for c in found))
    measured = durable(parts.groupBy(group, key, lat, lon).agg(*[F.sum(c).alias(c) for c in found]))
    best = measured.groupBy(group).agg(F.min(F.struct("km", key, lat, lon)).alias("_b")).join(sizes.select(group, "_weight"), group)
    marks = measured.join(best.select(group, F.col("_b.km").alias("_best"), "_weight"), group)
    cut = live.groupBy(group).agg(F.ceil(F.count("*") / (4 * MEDOID_BLOCK)).cast("long").alias("_blocks"))
    rows = live.join(cut, group).withColumn("_i", F.pmod(F.xxhash64(key), F.col("_blocks"))).drop("_blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    marks = marks.join(cut, group).select(F.col(group).alias("_g"), every.alias("_a"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), *found, "_best", "_weight")

    names = live.columns

    def kept(a: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(m):
            least = h.least_sums(a[[lat, lon]].to_numpy(float), m[["_lat", "_lon"]].to_numpy(float), m[found].to_numpy(float), m["_weight"].iloc[0])
            # Rounding to six decimals, and of the sums themselves, must not rule out any.
            a = a[least <= m["_best"].iloc[0] * (1 + 1e-9) + m["_weight"].iloc[0] * 1e-9 + 2e-6]
        return a[names]

    schema = ", ".join(f"{c} {live.schema[c].dataType.simpleString()}" for c in names)
    rest = rows.groupBy(group, "_i").cogroup(marks.groupBy("_g", "_a")).applyInPandas(kept, schema)
    return durable(rest), best.select(group, F.col(f"_b.{lat}").alias("_clat"), F.col(f"_b.{lon}").alias("_clon"))


def dense_subset(df: DataFrame, group: str, key: str, lat: str, lon: str, capacity: int) -> DataFrame:
    """df with dentro: among the capacity points nearest to their group's medoid (all, if there are no more)."""
    away = haversine_km(F.col(lat), F.col(lon), F.col("mlat"), F.col("mlon"))
    order = Window.partitionBy(group).orderBy("_km", key)
    return df.join(medoid(df, group, key, lat, lon), group).withColumn("_km", F.round(away, 9)).withColumn("dentro", F.row_number().over(order) <= capacity).select(*df.columns, "dentro")


def with_consultants(df: DataFrame, group: str, key: str, lat: str, lon: str, consultants: DataFrame, least: int | None, most: int | None, greedy: bool = False, overflow: bool = True) -> DataFrame:
    """(group, key, consultor, distancia_km, excedente): each group's points assigned to the consultants (id, lat, lon: a short list, taken to the driver).

    Without a band the nearest; greedy: in key order the nearest with room; else the assignment of least total distance within
    the band, which is relaxed where it cannot hold. Points without coordinates have no consultant and are not in excess.
    """
    staff = consultants.orderBy("id").limit(CENTRE_BLOCK + 1).collect()
    if not staff or len(staff) > CENTRE_BLOCK:
        raise ValueError(f"between 1 and {CENTRE_BLOCK} consultants are needed")
    if least is not None and most is not None and least > most:
        raise ValueError("the least is over the most")
    names, where = [r["id"] for r in staff], np.array([[r["lat"], r["lon"]] for r in staff])

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        d = h.km_matrix(xy, where)
        over = np.zeros(len(xy), bool)
        if greedy:
            at, over = h.greedy_nearest(d, most or len(xy), overflow)
        elif least is None and most is None:
            at = d.argmin(1)
        else:
            at = h.banded_assignment(d, least, most)[0]
        return pd.DataFrame({group: pdf[group], key: pdf[key], "consultor": [names[j] for j in at], "distancia_km": d[np.arange(len(xy)), at], "excedente": over})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    staff_kind = consultants.schema["id"].dataType.simpleString()
    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, consultor {staff_kind}, distancia_km double, excedente boolean"
    nowhere = df.where(F.col(lat).isNull() | F.col(lon).isNull()).select(
        group, key, F.lit(None).cast(staff_kind).alias("consultor"), F.lit(None).cast("double").alias("distancia_km"), F.lit(False).alias("excedente")
    )
    return per_group(df.select(group, key, lat, lon), [group], key, lat, lon, run, schema).unionByName(nowhere)


def band_status(n: Column, least: int | None, most: int | None) -> tuple[Column, Column]:
    """EXCEDENTE, ABAIXO_MIN or OK, and by how many points the most is passed."""
    over = F.lit(False) if most is None else n > most
    under = F.lit(False) if least is None else n < least
    return F.when(over, "EXCEDENTE").when(under, "ABAIXO_MIN").otherwise("OK"), F.lit(0).cast("long") if most is None else F.greatest(F.lit(0), n - most).cast("long")


def rebalanced(df: DataFrame, group: str, key: str, lat: str, lon: str, label: str, least: int | None, most: int | None, mode: str = "capacidade") -> DataFrame:
    """(group, key, label, banda_status): labels brought within the band; mode fixo only judges them (FORA_DA_BANDA).

    Clusters over the most are split by k-means, those under the least dissolved point by point into the nearest with room; what no cluster takes stays, ABAIXO_MIN.
    """
    if any(x is not None and x < 1 for x in (least, most)) or (least is not None and most is not None and least > most):
        raise ValueError("the band is not valid")

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        labels, status = h.within_band(xy, pdf[label].to_numpy(), least, most, mode)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "label": labels, "banda_status": status})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    return per_group(df.select(group, key, lat, lon, label), [group], key, lat, lon, run, f"{group} {kinds[group]}, {key} {kinds[key]}, label long, banda_status string")


def refined(df: DataFrame, group: str, key: str, lat: str, lon: str, k: int, **settings) -> DataFrame:
    """(group, cluster, day, points, km, minutes, ok): clusters added one by one until every day's route is within its limits."""
    s = DEFAULTS | settings

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        _, routes = h.refine(xy, k, s["days"], s["freq"], s["day_minutes"], s["day_km"], s["kmh"], s["service"], s["alpha"], s["rounds"])
        out = pd.DataFrame(routes)
        out.insert(0, group, pdf[group].iloc[0])
        return out

    kind = df.schema[group].dataType.simpleString()
    return per_group(df.select(group, key, lat, lon), [group], key, lat, lon, run, f"{group} {kind}, cluster long, day long, points long, km double, minutes double, ok boolean")


def theoretical_routes(df: DataFrame, group: str, key: str, lat: str, lon: str, most: int, **settings) -> DataFrame:
    """(group, key, label): groups cut by factors 2, 3, ... until each part's daily routes hold and no part is over `most`; small groups stay whole."""
    s = DEFAULTS | settings

    def fits(xy: np.ndarray) -> bool:
        if len(xy) > most:  # whatever its routes are
            return False
        labels, centres = h.kmeans(xy, min(max(1, s["days"] // max(s["freq"], 1)), len(xy)))
        for j in np.unique(labels):
            r = h.route(xy[labels == j], centres[j], s["kmh"], s["service"], s["alpha"])
            if r["minutes"] > s["day_minutes"] or r["km"] > s["day_km"]:
                return False
        return True

    def run(xy: np.ndarray) -> np.ndarray:
        def parts(own: np.ndarray, factor: int) -> list[np.ndarray]:
            if len(own) <= 4 or fits(xy[own]) or factor > 2 + s["rounds"]:
                return [own]
            labels, _ = h.kmeans(xy[own], factor)
            cut = [own[labels == j] for j in np.unique(labels)]
            return [own] if len(cut) < 2 else [x for c in cut for x in parts(c, factor + 1)]

        return _groups_to_labels(parts(np.arange(len(xy)), 2), len(xy))

    return labelled(df, group, key, lat, lon, run)


def radii_hold(df: DataFrame, p95: str, most_km: float) -> DataFrame:
    """(ok): three times every sector's 95th-percentile radius is within the route limit."""
    return df.agg(F.coalesce(F.bool_and(F.col(p95) * 3 <= most_km), F.lit(True)).alias("ok"))


def sector_summary(df: DataFrame, group: list[str], lat: str, lon: str) -> DataFrame:
    """Each sector's centre, size, and median and 95th-percentile distance from the centre. df is written once, for it is read four times."""
    df = durable(df.select(*group, lat, lon))
    mean = df.groupBy(*group).agg(F.avg(lat).alias("centro_lat"), F.avg(lon).alias("centro_lon"))
    km = haversine_km(F.col("centro_lat"), F.col("centro_lon"), F.col(lat), F.col(lon))
    away = df.join(mean, group).select(*group, "centro_lat", "centro_lon", km.alias("_km"))
    sizes = away.groupBy(*group, "centro_lat", "centro_lon").agg(F.count("*").alias("n_pdvs"))
    return sizes.join(reports.ranked_values(away, group, "_km", raio_med_km=reports.median_rank, raio_p95_km=reports.p95_rank), group, "left")


def passive_clusters(df: DataFrame, group: str, key: str, lat: str, lon: str, weight: str, kmh: float = 35.0, minutes: float = 60.0, most: int | None = None) -> DataFrame:
    """(group, key, label, clat, clon, distancia_km, tempo_min, is_outlier): postcodes of positive weight, clusters from the ratio of areas.

    k-means with more clusters, up to ten tries, until all points are within reach; centres are weighted means.
    """
    reach = kmh * minutes / 60

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        w = pdf[weight].to_numpy(float)
        w = w / w.max()
        span = float(h.km_matrix(xy.min(0)[None], xy.max(0)[None])[0, 0])
        k = min(max(1, int((span / 2) ** 2 / reach**2)), len(xy) // 3) or 1
        for _ in range(10):
            labels, _ = h.kmeans(xy, k)
            labels = np.unique(labels, return_inverse=True)[1]
            centres = np.array([np.average(xy[own], axis=0, weights=w[own]) for own in h._members(labels, np.arange(labels.max() + 1)).values()])
            km = h.km_between(xy, centres[labels])
            if km.max(initial=0) <= reach and (most is None or np.bincount(labels).max() <= most):
                break
            k += 1
        return pd.DataFrame({group: pdf[group], key: pdf[key], "label": labels, "clat": centres[labels, 0], "clon": centres[labels, 1], "distancia_km": km, "tempo_min": km / kmh * 60, "is_outlier": km > reach})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    rows = df.where(F.col(weight) > 0).select(group, key, lat, lon, weight)
    return per_group(rows, [group], key, lat, lon, run, f"{group} {kinds[group]}, {key} {kinds[key]}, label long, clat double, clon double, distancia_km double, tempo_min double, is_outlier boolean")


def active_clusters(points: DataFrame, centres: DataFrame, lat: str, lon: str, cid: str, clat: str, clon: str, kmh: float = 35.0, minutes: float = 60.0, most_km: float = 30.0) -> DataFrame:
    """points with their nearest centre, distance and time; those out of reach are dropped, so is_outlier is false on all that is kept."""
    near = nearest_centre(points, centres, lat, lon, cid, clat, clon).withColumn("tempo_min", F.col("distancia_km") / kmh * 60)
    return near.where((F.col("tempo_min") <= minutes) & (F.col("distancia_km") <= most_km)).withColumn("is_outlier", F.lit(False))


def balanced_centres(assigned: DataFrame, group: str, key: str, lat: str, lon: str, cid: str, centres: DataFrame, least: int, most: int, reach_km: float | None, kmh: float = 40.0) -> DataFrame:
    """(group, key, cid, distancia_km, tempo_min): points moved between fixed centres (id, lat, lon: a short list) to keep sizes within the band.

    Overfull centres hand their farthest points to the nearest with room within reach, small ones join the nearest; a point that is handed
    on goes to one centre only, and its own coordinates stay.
    """
    staff = centres.orderBy("id").limit(CENTRE_BLOCK + 1).collect()
    if len(staff) > CENTRE_BLOCK:
        raise ValueError(f"at most {CENTRE_BLOCK} centres")
    names, where = [r["id"] for r in staff], np.array([[r["lat"], r["lon"]] for r in staff])
    index = {x: i for i, x in enumerate(names)}

    def run(pdf: pd.DataFrame, xy: np.ndarray) -> pd.DataFrame:
        d = h.km_matrix(xy, where)
        labels = h.spill_balance(d, h.km_matrix(where, where), pdf[cid].map(index).to_numpy(), least, most, reach_km)
        km = d[np.arange(len(xy)), labels]
        return pd.DataFrame({group: pdf[group], key: pdf[key], cid: [names[j] for j in labels], "distancia_km": km, "tempo_min": km / kmh * 60})

    kinds = {c: assigned.schema[c].dataType.simpleString() for c in (group, key, cid)}
    return per_group(assigned.select(group, key, lat, lon, cid), [group], key, lat, lon, run, f"{group} {kinds[group]}, {key} {kinds[key]}, {cid} {kinds[cid]}, distancia_km double, tempo_min double")


def manual_sectors(points: DataFrame, choices: DataFrame, consultants: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Sectors as chosen by hand: (consultor, n_pdvs, raio_med_km, raio_p95_km).

    choices: (key, consultor). A point that is not in the table or is chosen twice, or a consultant (id, lat, lon, ativo) who is unknown or inactive, is an error.
    """
    if not choices.join(points.select(key), key, "left_anti").isEmpty():
        raise ValueError("a chosen point does not belong to this clustering")
    if not choices.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a point is chosen twice")
    active = consultants.where("ativo")
    if not choices.join(active.select(F.col("id").alias("consultor")), "consultor", "left_anti").isEmpty():
        raise ValueError("a chosen consultant is unknown or inactive")
    rows = choices.join(points.select(key, lat, lon), key).join(active.select(F.col("id").alias("consultor"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon")), "consultor")
    away = rows.select("consultor", haversine_km(F.col(lat), F.col(lon), F.col("_clat"), F.col("_clon")).alias("_km"))
    means = away.groupBy("consultor").agg(F.count("*").alias("n_pdvs"), F.round(F.avg("_km"), 3).alias("raio_med_km"))
    far = reports.ranked_values(away, ["consultor"], "_km", raio_p95_km=reports.nearest_p95_rank)
    return means.join(far, "consultor", "left").withColumn("raio_p95_km", F.round(F.coalesce("raio_p95_km", F.lit(0.0)), 3))


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "kmeans": lambda df, g, k, lat, lon, most: balanced_kmeans(df, g, k, lat, lon, most),
    "capacitated_sweep": lambda df, g, k, lat, lon, most: sweep(df, g, k, lat, lon, most).select(g, k, "label"),
    "sweep": lambda df, g, k, lat, lon, most: sweep(df, g, k, lat, lon, most, planar=True).select(g, k, "label"),
    "dense_subset": lambda df, g, k, lat, lon, most: dense_subset(df, g, k, lat, lon, most).select(g, k, F.when(F.col("dentro"), 0).otherwise(1).cast("long").alias("label")),
}


def cluster(df: DataFrame, group: str, key: str, lat: str, lon: str, algorithm: str, most: int, least: int | None = None, z: float = 3.0, drop_outliers: bool = True, limit: int | None = None) -> DataFrame:
    """The whole run: size guard, one row a key, outliers out, the algorithm, the band, and the sectors' labels from 0: (group, key, label, banda_status)."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}; there are {', '.join(sorted(ALGORITHMS))}")
    rows = guard_size(df, limit).select(group, key, lat, lon).dropDuplicates([key])
    kept = flag_outliers(rows, key, lat, lon, z).where("NOT is_outlier").select(group, key, lat, lon) if drop_outliers else rows
    labels = ALGORITHMS[algorithm](kept, group, key, lat, lon, most)
    return rebalanced(kept.join(labels, [group, key]), group, key, lat, lon, "label", least, most)
