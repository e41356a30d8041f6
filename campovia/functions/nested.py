"""JSON, arrays of coordinates and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDINATES = "array<struct<lat: double, lon: double>>"


def json_text(c: Column, key: str) -> Column:
    """The text at a top-level key of a JSON object."""
    return F.get_json_object(c, f"$.{key}")


def coordinates(c: Column) -> Column:
    """A JSON array of {lat, lon} objects or of [lat, lon] pairs as an array of points; single quotes are repaired."""
    fixed = F.replace(c, F.lit("'"), F.lit('"'))
    pairs = F.transform(F.from_json(fixed, "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("lat"), F.get(p, F.lit(1)).alias("lon")))
    return F.when(fixed.rlike(r"^\s*\[\s*\["), pairs).otherwise(F.from_json(fixed, COORDINATES))


def as_json(**fields: Column) -> Column:
    """A JSON object of the given fields."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def without_repeats(points: Column) -> Column:
    """Points equal to the one before them are dropped."""
    return F.filter(points, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(points, i - 1)))


def joined_segments(segments: Column) -> Column:
    """Segments as one line; a segment's first point is dropped where it equals the point before it."""
    return without_repeats(F.flatten(segments))


def polyline_decoded(c: Column) -> Column:
    """The points of an encoded polyline with five decimals, by folding over its characters."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch) - 63)
    start = F.struct(
        F.lit(0).cast("long").alias("bits"), F.lit(0).alias("shift"), F.lit(True).alias("is_lat"), F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon"),
        F.array().cast(COORDINATES).alias("points"),
    )

    def step(acc: Column, code: Column) -> Column:
        bits = acc["bits"] + code.bitwiseAND(F.lit(31)).cast("long") * F.pow(F.lit(2), acc["shift"]).cast("long")
        value = F.when(bits % 2 == 1, -((bits + 1) / 2).cast("long")).otherwise((bits / 2).cast("long"))
        more = code >= 32
        lat = F.when(more | ~acc["is_lat"], acc["lat"]).otherwise(acc["lat"] + value)
        lon = F.when(more | acc["is_lat"], acc["lon"]).otherwise(acc["lon"] + value)
        point = F.array(F.struct((lat / 1e5).alias("lat"), (lon / 1e5).alias("lon")))
        return F.struct(
            F.when(more, bits).otherwise(F.lit(0).cast("long")).alias("bits"), F.when(more, acc["shift"] + 5).otherwise(F.lit(0)).alias("shift"),
            F.when(more, acc["is_lat"]).otherwise(~acc["is_lat"]).alias("is_lat"), lat.alias("lat"), lon.alias("lon"),
            F.when(more | acc["is_lat"], acc["points"]).otherwise(F.concat(acc["points"], point)).alias("points"),
        )

    return F.aggregate(codes, start, step, lambda acc: acc["points"])


def chunk_of(position: Column, size: int) -> Column:
    """The chunk of a row position counted from 0."""
    return F.floor(position / size).cast("long")
