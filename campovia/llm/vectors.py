"""Reading of vector columns into matrices, shared by the searches, and meeting of blocks of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.session import durable

#: Rows of a candidate block and of a query block, and query blocks that one task takes together.
CANDIDATES, QUERIES, QUERY_BLOCKS = 8192, 512, 8


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool, more: Sequence[str] = ()) -> DataFrame:
    """(vec_id, v, and the columns more) with v as array<double>, of rows whose id is not null and whose vector is neither null nor empty nor holds null or non-finite components.

    zero says whether a vector of zeros is usable. Vectors keep the length they have.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *more)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    return kept if zero else kept.where(F.exists("v", lambda x: x != 0))


def distinct_queries(df: DataFrame) -> DataFrame:
    """(vec_id, v, key): different query rows. Rows that share an id and a vector are one query; rows that share an id alone are told apart by key."""
    return df.select("vec_id", "v").distinct().withColumn("key", F.xxhash64("v"))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.concatenate([np.empty(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)]).reshape(-1, dims)


def in_blocks(rows: DataFrame, asked: DataFrame, search: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str) -> DataFrame:
    """(query_id, key, vec_id, score) of what search(queries, ids, candidates, ids) picks, (query, candidate, score), from every block for every block of queries.

    rows (vec_id, v) are dealt to blocks of about CANDIDATES rows, asked (vec_id, v, key) to blocks of QUERIES, of which a task takes several; blocks meet by
    number. Rows are written first, so that a row's number in what was written, by which a row repeated many times is spread over blocks, stays
    when a task is run again. Vectors of every length lie in the same blocks; a task searches each length by itself, for only equally long ones have an inner product.
    """
    rows = durable(rows)
    row_blocks, groups = -(-rows.count() // CANDIDATES) or 1, -(-asked.count() // (QUERIES * QUERY_BLOCKS)) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id", "key"), F.lit(groups))).withColumn("blk", every(row_blocks))
    fresh = rows.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks)).alias("blk"))
    right = fresh.withColumn("grp", every(groups))

    def meet(asked_part: pa.Table, rows_part: pa.Table) -> pa.Table:
        parts = []
        if asked_part.num_rows and rows_part.num_rows:
            sizes = [t.column("v").combine_chunks().value_lengths().to_numpy() for t in (asked_part, rows_part)]
            for dims in np.intersect1d(*sizes):
                q, x = (t.take(pa.array(np.flatnonzero(s == dims))).sort_by("vec_id") for t, s in zip((asked_part, rows_part), sizes))
                i, j, score = search(matrix(q.column("v"), dims), q.column("vec_id").to_numpy(), matrix(x.column("v"), dims), x.column("vec_id").to_numpy())
                i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
                parts.append(pa.table([q.column("vec_id").take(i), q.column("key").take(i), x.column("vec_id").take(j), pa.array(score)], ["query_id", "key", "vec_id", "score"]))
        none = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if kind == "long" else pa.float64())])
        return pa.concat_tables(parts) if parts else none.empty_table()

    return left.groupBy("grp", "blk").cogroup(right.groupBy("grp", "blk")).applyInArrow(meet, f"query_id long, key long, vec_id long, score {kind}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to smaller ids."""
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
