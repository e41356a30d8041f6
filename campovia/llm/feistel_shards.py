"""Reproducible shuffle into shards: a Feistel permutation of global row numbers. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.session import durable

#: Different rows of a bucket, on average, in which rows are numbered side by side (each is sorted in one task), and the most
#: buckets, whose offsets are broadcast.
BUCKET_ROWS, MOST_BUCKETS = 65_536, 1_000_000
#: Copies of one row that one task unfolds.
COPIES_BLOCK = 65_536
ROUNDS = 4
#: Steps of the cycle walk. Under 4,097 rows none needs more; above, one step leaves the range with a
#: chance under 1 / 64, and a walk that should ever be longer ends the job with an error.
WALK = 64


def feistel(number: Column, left_size: int, right_size: int, seed: int) -> Column:
    """A permutation of [0, left_size * right_size): halves added to in turn by a keyed hash of the other one."""
    a, b = F.lit(left_size).cast("long"), F.lit(right_size).cast("long")
    left, right = F.floor(number / b), F.pmod(number, b)
    for k in range(ROUNDS):
        left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(2 * k)), a), a)
        right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(2 * k + 1)), b), b)
    return left * b + right


def place(number: Column, rows: int, seed: int) -> Column:
    """Where row `number` of `rows` goes: the permutation, walked on from places beyond the last row."""
    left = max(1, math.isqrt(rows))
    right = -(-rows // left)
    limit = F.lit(rows).cast("long")
    once = feistel(number, left, right, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(x < limit, x).otherwise(feistel(x, left, right, seed)))
    ended = F.when(walk < limit, walk).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))
    return F.when(once < limit, once).otherwise(ended)


def numbered(df: DataFrame, columns: list[str], number: str) -> tuple[DataFrame, int]:
    """Each row's given columns with a global row number from 0 that depends on the rows' values alone, and the row count.

    Equal rows are counted before they are shuffled and unfolded in blocks afterwards, so no row that is
    repeated very often lands in one task.
    """
    counted = durable(df.groupBy(*columns).agg(F.count("*").alias("_copies")))
    buckets = min(MOST_BUCKETS, -(-counted.count() // BUCKET_ROWS)) or 1
    kinds = counted.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    totals = kinds.groupBy("_bucket").agg(F.sum("_copies").alias("_own"))  # at most MOST_BUCKETS rows
    rows = totals.agg(F.coalesce(F.sum("_own"), F.lit(0))).first()[0]
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    starts = kinds.withColumn("_start", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(F.broadcast(offsets), "_bucket")
    block = F.lit(COPIES_BLOCK).cast("long")
    blocks = starts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / block))))
    spread = blocks.repartition(F.xxhash64(*columns), "_block")
    first = F.col("_block") * block
    copies = spread.withColumn("_copy", F.explode(F.sequence(first, F.least(first + block, F.col("_copies")) - 1)))
    return copies.select(*columns, (F.col("_offset") + F.col("_start") + F.col("_copy")).alias(number)), rows


def shard_rows(df: DataFrame, columns: list[str], shards: int = 16, seed: int = 42) -> DataFrame:
    """The given columns of every row with its place in a reproducible shuffle, its shard and its slot there.

    Rows get global numbers, a Feistel permutation keyed by seed moves them, and place p is slot
    p // shards of shard p % shards: shards differ by one row at most, slots are gapless from 0, and both can be
    computed from a row number without reading any other row. The order rests on values alone, so
    another layout of the same rows gives the same result; equal rows are interchangeable.

    Nulls are values like any others; nothing is dropped. Columns that are not named are not read, so their
    names cannot clash; the result adds place, shard and slot, which columns may not be called. An
    empty table gives an empty result.
    """
    if clash := {"place", "shard", "slot"} & {c.lower() for c in columns}:
        raise ValueError(f"columns may not be called {sorted(clash)}")
    rows_of, rows = numbered(df.select(*columns), columns, "_number")
    moved = rows_of.withColumn("place", place(F.col("_number"), max(rows, 1), seed)).drop("_number")
    count = F.lit(shards).cast("long")
    return moved.withColumn("shard", F.pmod("place", count).cast("int")).withColumn("slot", F.floor(F.col("place") / count).cast("long"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shard_rows' result as one folder a shard, each file's rows in order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
