"""Deduplication by order, rejection, and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions.ids import source_rank


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (make it total); a null key is a key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def last_by(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of each key that comes last by position."""
    return first_by(df, keys, [F.col(position).desc()])


def split_repeated(df: DataFrame, keys: list[str], reason: str = "motivo_invalidade", code: str = "cnpj_duplicado_arquivo") -> tuple[DataFrame, DataFrame]:
    """Rows of keys that occur once, and all rows of the other keys with the reason.

    Counts are aggregated before they are joined back, so a very frequent key makes no large window.
    """
    counts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_times"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    judged = df.join(counts, on).select(*df.columns, "_times")
    return judged.where("_times = 1").drop("_times"), judged.where("_times > 1").drop("_times").withColumn(reason, F.lit(code))


def best_result(df: DataFrame, key: str, lat: str, lon: str, source: str, order: list[str]) -> DataFrame:
    """Of each key the row with coordinates first, then by its source's rank, then in the given order."""
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return first_by(df, [key], [placed.desc(), source_rank(F.col(source)), *[F.col(c) for c in order]])


def append_missing(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """df and the rows of more whose key it does not have yet."""
    return df.unionByName(more.join(df.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
