"""Table changes as DataFrames: inserts, upserts, updates, deletes and snapshots. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MANUAL = "manual_edit"


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """On conflict do nothing: rows of new keys are added, the first of each key among them."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = rows.join(target.select(*keys), keys, "left_anti").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """On conflict update: of each key the row of the highest version; incoming rows win a tie."""
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.select(*target.columns).withColumn("_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(version)))
    return both.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_new")


def guarded_upsert(target: DataFrame, rows: DataFrame, key: str, values: list[str], source: str) -> DataFrame:
    """An upsert that leaves rows alone that were edited by hand; both sides have unique keys."""
    old, new = target.select(key, F.struct(*values, source).alias("o")), rows.select(key, F.struct(*values, source).alias("n"))
    joined = old.join(new, key, "full")
    keep = F.col("n").isNull() | F.coalesce(F.col("o")[source].eqNullSafe(F.lit(MANUAL)) & F.col("o").isNotNull(), F.lit(False))
    return joined.select(key, F.when(keep, F.col("o")).otherwise(F.col("n")).alias("v")).select(key, *[F.col("v")[c].alias(c) for c in (*values, source)])


def update_from(target: DataFrame, changes: DataFrame, keys: list[str], column: str, only_empty: bool = True) -> DataFrame:
    """The column is set from changes where it is empty (or everywhere a change is given); changes have unique keys."""
    given = changes.select(*keys, F.col(column).alias("_given"))
    old, new = F.col(column), F.col("_given")
    value = F.coalesce(old, new) if only_empty else F.coalesce(new, old)
    return target.join(given, keys, "left").withColumn(column, value).select(*target.columns)


def fail_pending(df: DataFrame, lat: str, lon: str, status: str, failed: str = "geo_fail") -> DataFrame:
    """Pending rows without coordinates are marked as failed."""
    pending = F.col(status).isNull() | (F.col(status) == "pending")
    return df.withColumn(status, F.when(pending & (F.col(lat).isNull() | F.col(lon).isNull()), failed).otherwise(F.col(status)))


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Delete rows and all that depend on them.

    links: (parent, parent key, child, child key) in order from the root down. doomed holds the root keys. Children
    of deleted parents go, level by level, each by a semi join and an anti join on keys alone.
    """
    gone = {root: tables[root].join(doomed.select(key), key, "left_semi")}
    left = dict(tables) | {root: tables[root].join(doomed.select(key), key, "left_anti")}
    for parent, parent_key, child, child_key in links:
        dead = gone[parent].select(F.col(parent_key).alias(child_key)).distinct()
        hit = left[child].join(dead, child_key, "left_semi")
        gone[child] = gone[child].unionByName(hit) if child in gone else hit
        left[child] = left[child].join(dead, child_key, "left_anti")
    return left


def set_active(df: DataFrame, doomed: Column, flag: str = "ativo", value: bool = False) -> DataFrame:
    """A soft delete (or its undoing): the flag is set where the condition holds."""
    return df.withColumn(flag, F.when(F.coalesce(doomed, F.lit(False)), F.lit(value)).otherwise(F.col(flag)))


def snapshot(tables: dict[str, DataFrame], path: str, snapshot_id: str) -> None:
    """Freeze tables under an id: one Parquet folder a table, partitioned by snapshot."""
    for name, df in tables.items():
        df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(f"{path}/{name}")


def restore(spark, path: str, name: str, snapshot_id: str) -> DataFrame:
    """A table as the snapshot has it."""
    return spark.read.parquet(f"{path}/{name}").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
