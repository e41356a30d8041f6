"""Table sinks: text with local number forms, JSON, GeoJSON, several sheets, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decimals(df: DataFrame, places: int = 2, comma: bool = False) -> DataFrame:
    """df with floating columns as text of a fixed number of decimals, with a point or a comma."""
    shown = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            written = F.format_string(f"%.{places}f", F.col(field.name).cast("double"))
            shown[field.name] = F.when(F.col(field.name).isNotNull(), F.replace(written, F.lit("."), F.lit(",")) if comma else written)
    return df.withColumns(shown) if shown else df


def write_csv(df: DataFrame, path: str, comma: bool = False, sep: str = ";") -> None:
    """Semicolon-separated text with two decimals; with comma, decimal commas."""
    decimals(df, 2, comma).write.mode("overwrite").csv(path, sep=sep, header=True, encoding="utf-8")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a line; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One folder of text a sheet: detail, summary, metrics, rejected rows."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a Parquet table."""
    df.write.mode("append").parquet(path)


def point_feature(lat: Column, lon: Column, **properties: Column) -> Column:
    """A GeoJSON point as text; coordinates are longitude, latitude."""
    return _feature("Point", F.array(lon, lat), properties)


def line_feature(points: Column, **properties: Column) -> Column:
    """A GeoJSON line as text, of an array of (lat, lon); null under two points."""
    line = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    return F.when(F.size(points) >= 2, _feature("LineString", line, properties))


def _feature(kind: str, coordinates: Column, properties: dict[str, Column]) -> Column:
    shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def feature_collection(df: DataFrame, feature: str, order: list[str], group: str | None = None) -> DataFrame:
    """One FeatureCollection as text (for each group, if given), of the features that are not null, in the given order.

    A collection is one document, so its features meet in one row.
    """
    kept = df.where(F.col(feature).isNotNull())
    grouped = kept.groupBy(group) if group else kept.groupBy()
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct(*order, feature))).alias("_f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("_f", lambda x: x[feature]), ","), F.lit("]}"))
    return listed.select(*([group] if group else []), text.alias("geojson"))
