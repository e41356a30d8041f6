"""Spatial joins: nearest centres, radius and nearest-neighbour joins, polygons, outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campovia.functions.geo import EARTH_KM, haversine_km, planar_sq
from campovia.operators.nearest import nearest_others
from campovia.session import durable

#: km of one degree of latitude, a little under the sphere's 111.19 so that bounds stay bounds.
DEGREE_KM = 111.1


def cell(c: Column, size: float) -> Column:
    """The grid line below a coordinate."""
    return F.floor(c / size).cast("long")


def within_km(left: DataFrame, right: DataFrame, km: float, lat: str, lon: str, rlat: str, rlon: str) -> DataFrame:
    """Pairs of rows at most km apart, with their distance. Only rows of neighbouring grid cells meet.

    Rows lie in bands of latitude as high as the distance. A band is cut into as many cells of longitude, around the whole circle, as
    leave none narrower than the distance on its side towards the pole, so a row meets its own cell and its neighbours', across the date line too; a band
    at a pole is one cell. Rows without coordinates are in no pair. The cells are dealt to all tasks of a shuffle, for rows are small and pairs are many, and of two
    rows that meet the product of their places on the sphere tells first whether they can be so near.
    """
    size = km / DEGREE_KM
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = math.cos(min(math.pi, km / EARTH_KM)) - 1e-12  # rounding is far below

    def on_sphere(df: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
        p, q = F.radians(lat), F.radians(lon)
        return df.withColumns({f"{name}x": F.cos(p) * F.cos(q), f"{name}y": F.cos(p) * F.sin(q), f"{name}z": F.sin(p)})

    def cells(band: Column) -> Column:
        """How many cells a band has: one where it is near a pole."""
        edge = F.radians(F.least(F.lit(90.0), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * size))
        widest = 2 * F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(size, 180) / 2))) / F.greatest(F.cos(edge), F.lit(1e-12))))  # longitudes that rows this near can differ by
        return F.greatest(F.lit(1), F.floor(F.lit(2 * math.pi / 1.001) / widest)).cast("long")

    turned = lambda c: F.pmod(c + 180.0, F.lit(360.0)) / 360.0  # noqa: E731  0 to 1 around the circle
    column = lambda x, n: F.pmod(F.floor(turned(x) * n).cast("long"), n)
    placed = right.withColumn("_y", cell(F.col(rlat), size)).withColumn("_n", cells(F.col("_y"))).withColumn("_x", column(F.col(rlon), F.col("_n"))).drop("_n")
    rows = left.withColumn("_y", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(F.col(lat), size) + d))).withColumn("_n", cells(F.col("_y")))
    mine = column(F.col(lon), F.col("_n"))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(mine + d, F.col("_n"))))
    rows = on_sphere(rows.withColumn("_x", F.explode(around)).drop("_n"), lat, lon, "_l").repartition(parts, "_y", "_x")
    placed = on_sphere(placed, rlat, rlon, "_r").repartition(parts, "_y", "_x")
    product = sum((F.col(f"_l{c}") * F.col(f"_r{c}") for c in "yz"), F.col("_lx") * F.col("_rx"))
    near = rows.join(placed, ["_y", "_x"]).where(product >= least)
    measured = near.withColumn("km", haversine_km(F.col(lat), F.col(lon), F.col(rlat), F.col(rlon))).where(F.col("km") <= km)
    return measured.drop("_y", "_x", *[f"_{side}{c}" for side in "lr" for c in "xyz"])


def flag_outliers(points: DataFrame, key: str, lat: str, lon: str, z: float = 1.5, k: int = 5, least: int = 5) -> DataFrame:
    """points with distancia_km, to the nearest other point, distancia_media_km, to the k nearest, and is_outlier.

    An outlier's nearest other point is farther than the mean of these distances plus z population standard
    deviations; with fewer than `least` points there are none.
    """
    near = nearest_others(points, key, lat, lon, k)
    mean = F.aggregate("kms", F.lit(0.0), lambda a, x: a + x) / F.size("kms")
    measured = durable(near.select(key, F.get("kms", F.lit(0)).alias("distancia_km"), F.when(F.size("kms") > 0, mean).alias("distancia_media_km")))
    bar = measured.agg((F.avg("distancia_km") + z * F.stddev_pop("distancia_km")).alias("_bar"), F.count("*").alias("_n"))
    judged = measured.crossJoin(F.broadcast(bar)).withColumn("is_outlier", F.coalesce((F.col("_n") >= least) & (F.col("distancia_km") > F.col("_bar")), F.lit(False)))
    return points.join(judged.drop("_bar", "_n"), key)


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """Ray casting: an odd number of the ring's edges lies east of the point. ring: array of (lon, lat), closed or not."""
    size = F.size(ring)

    def crosses(a: Column, i: Column) -> Column:
        b = F.get(ring, F.when(i + 1 == size, F.lit(0)).otherwise(i + 1))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return spans & (lon < at)

    return F.size(F.filter(ring, lambda a, i: F.coalesce(crosses(a, i), F.lit(False)))) % 2 == 1


def edge_distance(ring: Column, lat: Column, lon: Column) -> Column:
    """The distance in degrees to the ring's nearest edge."""
    size = F.size(ring)

    def to_edge(a: Column, i: Column) -> Column:
        b = F.get(ring, F.when(i + 1 == size, F.lit(0)).otherwise(i + 1))
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        length = dx * dx + dy * dy
        s = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / length)))
        return planar_sq(lat, lon, a["lat"] + s * dy, a["lon"] + s * dx)

    return F.sqrt(F.array_min(F.transform(ring, to_edge)))


def point_in_place(points: DataFrame, polygons: DataFrame, keys: list[str], lat: str, lon: str, buffer: float = 0.005, unknown: bool | None = None) -> DataFrame:
    """points with dentro: inside its place's rings or within buffer degrees of an edge.

    polygons: (keys, rings), one row a place; a point in an odd number of rings is inside, so holes are out. Points without
    coordinates are False, points of unknown places `unknown`. Only a place's own polygon is looked at, by an equi-join;
    the bounding box is tried before the edges.
    """
    lat_c, lon_c = F.col(lat), F.col(lon)
    corners = lambda f: lambda c: f(F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c]))))
    boxed = polygons.withColumn("_box", F.struct(*[corners(f)(c).alias(n) for n, f, c in (("s", F.array_min, "lat"), ("n", F.array_max, "lat"), ("w", F.array_min, "lon"), ("e", F.array_max, "lon"))]))
    near = lat_c.between(F.col("_box.s") - buffer, F.col("_box.n") + buffer) & lon_c.between(F.col("_box.w") - buffer, F.col("_box.e") + buffer)
    inside = F.size(F.filter("rings", lambda r: in_ring(r, lat_c, lon_c))) % 2 == 1
    close = F.exists("rings", lambda r: edge_distance(r, lat_c, lon_c) <= buffer)
    verdict = F.when(lat_c.isNull() | lon_c.isNull(), False).when(F.col("rings").isNull(), F.lit(unknown)).when(~near, False).otherwise(inside | close)
    return points.join(boxed, keys, "left").select(*points.columns, verdict.cast("boolean").alias("dentro"))
