"""Nearest centres: a tree of boxes over the centres, searched best first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campovia.functions.geo import EARTH_KM, haversine_km
from campovia.session import durable

#: Centres that are sent whole to every task (three numbers each); more are cut into shards of about half as many.
CENTRES_AT_ONCE = 400_000
#: Points of a shard that one task takes.
SHARD_POINTS = 200_000
#: Degrees of latitude of the strips by which points are dealt out.
STRIP = 0.1
#: Centres of a leaf, children of a node, and points that go down the tree together.
LEAF, FAN, TOGETHER = 16, 8, 128


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Unit vectors; the nearer two places, the shorter the chord between them."""
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)


def compact_order(xyz: np.ndarray, most: int) -> np.ndarray:
    """An order in which every run of `most` places lies close together: halves by the widest side, again and again."""
    order, todo = np.arange(len(xyz)), [(0, len(xyz))]
    while todo:
        a, b = todo.pop()
        if b - a > most:
            part = order[a:b]
            side = int(np.ptp(xyz[part], axis=0).argmax())
            half = max(1, (b - a) // (2 * most)) * most  # whole runs on the left
            order[a:b] = part[np.argpartition(xyz[part, side], half - 1)] if half < b - a else part
            todo += [(a, a + half), (a + half, b)]
    return order


def apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared chords: the least and the most between a place of the box (or boxes) low to high and one of each box lows to highs."""
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    span = np.maximum(highs - low, high - lows)
    return (gap * gap).sum(axis=-1), (span * span).sum(axis=-1)


class CentreTree:
    """Centres in leaves of LEAF, leaves in nodes of FAN, and so on up; every node knows its box. Centres come in the order that ties go by."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        xyz = on_sphere(lat, lon)
        self.order = compact_order(xyz, LEAF)
        self.lat, self.lon = np.radians(lat[self.order]), np.radians(lon[self.order])
        laid = xyz[self.order]
        starts = np.arange(0, len(laid), LEAF)
        self.levels = [(np.minimum.reduceat(laid, starts), np.maximum.reduceat(laid, starts))]
        while len(self.levels[-1][0]) > FAN:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
        #: Centres below each node; only the last one of a level may have fewer than the others.
        self.counts = [np.minimum(LEAF * FAN**d, len(laid) - LEAF * FAN**d * np.arange(len(low))) for d, (low, _) in enumerate(self.levels)]
        self.measured = 0  # pairs of point and centre whose distance was computed

    def leaves_near(self, places: np.ndarray, k: int = 1) -> np.ndarray:
        """The leaves that may hold any of the k nearest centres of any of some places that lie close together."""
        low, high = places.min(axis=0), places.max(axis=0)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            lows, highs = self.levels[depth]
            least, most = apart(low, high, lows[nodes], highs[nodes])
            sure = np.argsort(most)  # so far away there are k centres for certain
            enough = np.searchsorted(np.cumsum(self.counts[depth][nodes[sure]]), k)
            if enough < len(nodes):
                nodes = nodes[least <= most[sure[enough]] * (1 + 1e-9) + 1e-13]
            if depth:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return nodes

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centre, km) of each point's nearest centre; of equally near ones the first in the order in which centres came."""
        xyz = on_sphere(lat, lon)
        p, q = np.radians(lat), np.radians(lon)
        best, km = np.zeros(len(lat), np.int64), np.full(len(lat), np.inf)
        order = compact_order(xyz, TOGETHER)
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            leaves = self.leaves_near(xyz[own])
            lows, highs = (x[leaves] for x in self.levels[0])
            least = apart(xyz[own, None], xyz[own, None], lows[None], highs[None])[0]
            turn = np.argsort(least, axis=1, kind="stable")
            live = np.arange(len(own))
            for step in range(len(leaves)):  # a point ends when its next leaf is farther than what it has
                reach = 4 * np.sin(km[own[live]] / (2 * EARTH_KM)) ** 2 if step else np.full(len(live), np.inf)
                live = live[least[live, turn[live, step]] <= reach * (1 + 1e-9) + 1e-13]
                if not len(live):
                    break
                row = own[live]
                cell = leaves[turn[live, step], None] * LEAF + np.arange(LEAF)
                inside = np.minimum(cell, len(self.lat) - 1)
                h = np.sin((self.lat[inside] - p[row, None]) / 2) ** 2 + np.cos(p[row, None]) * np.cos(self.lat[inside]) * np.sin((self.lon[inside] - q[row, None]) / 2) ** 2
                away = np.where(cell < len(self.lat), 2 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0))), np.inf)
                self.measured += int((cell < len(self.lat)).sum())
                centre = np.where(away == away.min(axis=1)[:, None], self.order[inside], len(self.lat)).min(axis=1)
                found = away.min(axis=1)
                better = (found < km[row]) | ((found == km[row]) & (centre < best[row]))
                best[row[better]], km[row[better]] = centre[better], found[better]
        return best, km

    def k_nearest(self, lat: np.ndarray, lon: np.ndarray, k: int) -> np.ndarray:
        """The km to each point's k nearest centres, in rising order; infinite where there are no more."""
        xyz = on_sphere(lat, lon)
        p, q = np.radians(lat), np.radians(lon)
        best = np.full((len(lat), k), np.inf)
        order = compact_order(xyz, TOGETHER)
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            leaves = self.leaves_near(xyz[own], k)
            lows, highs = (x[leaves] for x in self.levels[0])
            least = apart(xyz[own, None], xyz[own, None], lows[None], highs[None])[0]
            turn = np.argsort(least, axis=1, kind="stable")
            live = np.arange(len(own))
            for step in range(len(leaves)):
                far = best[own[live], -1]
                reach = np.where(np.isfinite(far), 4 * np.sin(np.minimum(far, np.pi * EARTH_KM) / (2 * EARTH_KM)) ** 2, np.inf)
                live = live[least[live, turn[live, step]] <= reach * (1 + 1e-9) + 1e-13]
                if not len(live):
                    break
                row = own[live]
                cell = leaves[turn[live, step], None] * LEAF + np.arange(LEAF)
                inside = np.minimum(cell, len(self.lat) - 1)
                h = np.sin((self.lat[inside] - p[row, None]) / 2) ** 2 + np.cos(p[row, None]) * np.cos(self.lat[inside]) * np.sin((self.lon[inside] - q[row, None]) / 2) ** 2
                away = np.where(cell < len(self.lat), 2 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0))), np.inf)
                self.measured += int((cell < len(self.lat)).sum())
                best[row] = np.sort(np.concatenate([best[row], away], axis=1), axis=1)[:, :k]
        return best


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Coordinates as doubles, nulls as nan."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()


def nearest_centre(points: DataFrame, centres: DataFrame, lat: str, lon: str, cid: str, clat: str, clon: str) -> DataFrame:
    """points with the nearest centre's id and distance in km; ties go to the smaller id.

    The centres, one a place, make a tree of boxes; points that lie close together go down it together, and each then reads leaves, the nearest first, until
    no leaf can hold a nearer centre. Points are dealt by range first, so that a batch is a small area and every task has its part of them, in however few
    files they came. So a point is compared with a few dozen centres, however many there are. Up to
    CENTRES_AT_ONCE places the tree goes to every task; beyond, places are cut into shards by range, each point is searched in the shard nearest to it, and then in those
    whose box is nearer than what it found. No pair of point and centre becomes a row.

    Without centres, and for points without (finite) coordinates, both are null; centres without coordinates or id are none. All columns of points stay,
    repeated rows too; they may not be called like the two new ones.
    """
    known = lambda a, b: a.isNotNull() & b.isNotNull() & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    sites = centres.where(F.col(cid).isNotNull() & known(F.col(clat), F.col(clon)) & ~F.isnan(clat) & ~F.isnan(clon)).groupBy(F.col(clat).cast("double").alias("clat"), F.col(clon).cast("double").alias("clon")).agg(F.min(cid).alias("cid"))
    sites = durable(sites)
    many = sites.count() > CENTRES_AT_ONCE
    # columns by place meanwhile: functions over Arrow batches take no names with dots
    plain = [f"c{i}" for i in range(len(points.columns))]
    own_lat, own_lon = (plain[points.columns.index(c)] for c in (lat, lon))
    found = (_by_shards if many else _at_once)(points.toDF(*plain), sites, own_lat, own_lon)
    km = F.when(F.col("_cid").isNotNull(), haversine_km(F.col(own_lat), F.col(own_lon), F.col("_clat"), F.col("_clon")))
    return found.select(*(F.col(p).alias(c) for p, c in zip(plain, points.columns)), F.col("_cid").alias(cid), km.alias("distancia_km"))


def _search(tree: CentreTree | None, sites: pa.Table, lat: np.ndarray, lon: np.ndarray) -> list[pa.Array]:
    """Id and coordinates of each point's nearest site, null for points without coordinates."""
    good = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
    place = np.full(len(lat), -1)
    if tree is not None and len(good):
        place[good] = tree.nearest(lat[good], lon[good])[0]
    taken = pa.array(place, mask=place < 0)
    return [sites.column(c).combine_chunks().take(taken) for c in ("cid", "clat", "clon")]


def _at_once(points: DataFrame, sites: DataFrame, lat: str, lon: str) -> DataFrame:
    listed = sites.orderBy("cid").toArrow()  # at most CENTRES_AT_ONCE rows
    sent = points.sparkSession.sparkContext.broadcast(listed)
    at = [points.columns.index(c) for c in (lat, lon)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tree = CentreTree(numbers(own.column("clat")), numbers(own.column("clon"))) if own.num_rows else None
        for batch in batches:
            more = _search(tree, own, *(numbers(batch.column(i)) for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_cid", "_clat", "_clon"])

    # Small rows, long work: a fixed number of tasks, whatever the bytes.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strip = [F.floor(F.col(lat) / STRIP), F.col(lon)]
    return points.repartitionByRange(parts, *strip).sortWithinPartitions(*strip).mapInArrow(search, _with_site(points.schema.fields, sites))


def _with_site(fields: list, sites: DataFrame) -> T.StructType:
    site = [T.StructField("_cid", sites.schema["cid"].dataType), T.StructField("_clat", T.DoubleType()), T.StructField("_clon", T.DoubleType())]
    return T.StructType([*fields, *site])


def _by_shards(points: DataFrame, sites: DataFrame, lat: str, lon: str) -> DataFrame:
    """The search where the sites are too many for one task."""
    shards = -(-2 * sites.count() // CENTRES_AT_ONCE)
    cut = durable(sites.repartitionByRange(shards, "clat", "clon").withColumn("shard", F.spark_partition_id()))
    xyz = {"x": F.cos(F.radians("clat")) * F.cos(F.radians("clon")), "y": F.cos(F.radians("clat")) * F.sin(F.radians("clon")), "z": F.sin(F.radians("clat"))}
    boxes = cut.groupBy("shard").agg(*(f(c).alias(f"{f.__name__}_{n}") for f in (F.min, F.max) for n, c in xyz.items())).orderBy("shard").collect()  # a row a shard
    names, low, high = [b.shard for b in boxes], np.array([b[1:4] for b in boxes]), np.array([b[4:7] for b in boxes])
    rows = durable(points.withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.select("_row", F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    where = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))
    asked = asked.where(where).withColumn("km", F.lit(None).cast("double")).withColumn("first", F.lit(-1))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard to search: at first the nearest one, later the others that may hold a nearer site."""
        for batch in batches:
            place = on_sphere(numbers(batch.column("lat")), numbers(batch.column("lon")))
            least = apart(place[:, None], place[:, None], low[None], high[None])[0]
            km = numbers(batch.column("km"))
            reach = 4 * np.sin(km / (2 * EARTH_KM)) ** 2 * (1 + 1e-9) + 1e-13
            nearest = np.arange(len(names))[None] == least.argmin(axis=1)[:, None]
            open_ = np.where(np.isnan(km)[:, None], nearest, (least <= reach[:, None]) & (np.array(names)[None] != batch.column("first").to_numpy()[:, None]))
            i, j = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(i)) for c in ("_row", "lat", "lon")), pa.array(np.array(names, np.int32)[j])], ["_row", "lat", "lon", "to"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("cid")
        tree = CentreTree(numbers(right.column("clat")), numbers(right.column("clon"))) if right.num_rows else None
        site = _search(tree, right, numbers(left.column("lat")), numbers(left.column("lon")))
        return pa.Table.from_arrays([*(left.column(c) for c in ("_row", "lat", "lon", "to")), *site], ["_row", "lat", "lon", "to", "_cid", "_clat", "_clon"])

    head = [T.StructField("_row", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("to", T.IntegerType())]

    def round_of(waiting: DataFrame) -> DataFrame:
        aimed = durable(waiting.mapInArrow(aim, T.StructType(head)))
        groups = aimed.groupBy("to").agg(F.ceil(F.count("*") / SHARD_POINTS).cast("long").alias("n"))  # a row a shard
        left = aimed.join(F.broadcast(groups), "to").withColumn("part", F.pmod(F.xxhash64("_row"), "n"))
        right = cut.join(F.broadcast(groups), cut["shard"] == groups["to"]).select("cid", "clat", "clon", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("of"))
        out = left.groupBy("to", "part").cogroup(right.groupBy("shard", "of")).applyInArrow(meet, _with_site(head, sites))
        return durable(out.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("_clat"), F.col("_clon"))))

    first = round_of(asked)
    second = round_of(first.select("_row", "lat", "lon", "km", F.col("to").alias("first")))
    best = first.unionByName(second).groupBy("_row").agg(F.min(F.struct("km", "_cid", "_clat", "_clon")).alias("b")).select("_row", "b._cid", "b._clat", "b._clon")
    return rows.join(best, "_row", "left").drop("_row")


#: Places of a shard of the nearest-neighbour search.
SHARD_PLACES = 100_000


def nearest_others(points: DataFrame, key: str, lat: str, lon: str, k: int) -> DataFrame:
    """(key, kms): distances in rising order to the k nearest other points (fewer if there are fewer).

    Places are cut by range into shards of about SHARD_PLACES, so a dense town makes more shards, not a larger one. Each shard searches its own places in a
    tree; a place whose k-th distance reaches over the box of another shard is searched there too, and the k least of what is found are taken. Points
    at one place are counted with their number, so a place that holds many is one place. Points without (finite) coordinates have kms null.
    """
    real = lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)
    own = points.select(F.col(key), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    places = durable(own.where(real(F.col("lat")) & real(F.col("lon"))).groupBy("lat", "lon").agg(F.count("*").alias("n")))
    shards = -(-places.count() // SHARD_PLACES) or 1
    cut = durable(places.repartitionByRange(shards, "lat", "lon").withColumn("shard", F.spark_partition_id()))
    x, y, z = F.cos(F.radians("lat")) * F.cos(F.radians("lon")), F.cos(F.radians("lat")) * F.sin(F.radians("lon")), F.sin(F.radians("lat"))
    boxes = cut.groupBy("shard").agg(*(F.min(c) for c in (x, y, z)), *(F.max(c) for c in (x, y, z))).orderBy("shard").collect()  # a row a shard
    names, low, high = np.array([b[0] for b in boxes], np.int32), np.array([b[1:4] for b in boxes], float).reshape(-1, 3), np.array([b[4:7] for b in boxes], float).reshape(-1, 3)

    def tree_of(table: pa.Table, most: int) -> CentreTree:
        times = np.minimum(table.column("n").to_numpy(), most)
        return CentreTree(np.repeat(numbers(table.column("lat")), times), np.repeat(numbers(table.column("lon")), times))

    def at_home(table: pa.Table) -> pa.Table:
        here = [numbers(table.column(c)) for c in ("lat", "lon")]
        kms = tree_of(table, k + 1).k_nearest(*here, k + 1)[:, 1:]  # the nearest is the point itself
        return pa.table([table.column("lat"), table.column("lon"), table.column("shard"), pa.array(list(kms), pa.list_(pa.float64()))], ["lat", "lon", "shard", "kms"])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = on_sphere(numbers(batch.column("lat")), numbers(batch.column("lon")))
            far = batch.column("kms").flatten().to_numpy().reshape(-1, k)[:, -1]
            reach = np.where(np.isfinite(far), 4 * np.sin(np.minimum(far, np.pi * EARTH_KM) / (2 * EARTH_KM)) ** 2, np.inf) * (1 + 1e-9) + 1e-13
            i, j = np.nonzero((apart(place[:, None], place[:, None], low[None], high[None])[0] <= reach[:, None]) & (names[None] != batch.column("shard").to_numpy()[:, None]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(i)) for c in ("lat", "lon")), pa.array(names[j])], ["lat", "lon", "to"])

    def abroad(left: pa.Table, right: pa.Table) -> pa.Table:
        kms = tree_of(right, k).k_nearest(*(numbers(left.column(c)) for c in ("lat", "lon")), k) if left.num_rows else np.empty((0, k))
        return pa.table([left.column("lat"), left.column("lon"), pa.array(list(kms), pa.list_(pa.float64()))], ["lat", "lon", "kms"])

    home = durable(cut.groupBy("shard").applyInArrow(at_home, "lat double, lon double, shard int, kms array<double>"))
    asked = durable(home.mapInArrow(aim, "lat double, lon double, to int"))
    parts = asked.groupBy("to").agg(F.ceil(F.count("*") / SHARD_PLACES).cast("long").alias("parts"))  # a row a shard
    left = asked.join(F.broadcast(parts), "to").withColumn("part", F.pmod(F.xxhash64("lat", "lon"), "parts"))
    right = cut.join(F.broadcast(parts), cut["shard"] == parts["to"]).select("lat", "lon", "n", F.col("shard").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("of"))
    other = left.groupBy("to", "part").cogroup(right.groupBy("at", "of")).applyInArrow(abroad, "lat double, lon double, kms array<double>")
    whole = home.select("lat", "lon", "kms").unionByName(other).groupBy("lat", "lon").agg(F.flatten(F.collect_list("kms")).alias("all"))
    found = whole.select("lat", "lon", F.slice(F.array_sort(F.filter("all", lambda d: d < float("inf"))), 1, k).alias("kms"))
    return own.join(found, ["lat", "lon"], "left").select(key, "kms")
