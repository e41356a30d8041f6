"""Approximate nearest neighbours: inverted lists scanned by an adaptive number of rotated dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campovia.llm.vectors import distinct_queries, in_blocks, ranked, usable
from campovia.session import durable

#: Vectors that lists are packed into or split at for one task, and queries that one task takes.
GROUP_ROWS, GROUP_QUERIES = 8192, 2048
#: Rotated dimensions of a column block, and the share of pairs left under which pairs are followed one by one.
COLUMNS, SPARSE = 16, 0.03
#: Queries of a list that are scanned at once, and the most lists.
QUERY_BLOCK, MAX_LISTS = 256, 4096
#: Lengths of vectors that have an index each, the most frequent ones; all others together are searched exactly, in blocks.
INDEXED_LENGTHS = 8
#: Sample rows that play queries to find out how far to probe.
PSEUDO_QUERIES = 512


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)


def centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from a random start; an empty centre moves to the point farthest from its own. Equal centres are one: there may be fewer than lists."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = np.empty(len(sample), np.int64)
        far = np.empty(len(sample))
        for at in range(0, len(sample), 2048):
            d = squared(sample[at : at + 2048], centres)
            near[at : at + 2048], far[at : at + 2048] = d.argmin(axis=1), d.min(axis=1)
        counts = np.bincount(near, minlength=lists)
        sums = np.stack([np.bincount(near, sample[:, j], lists) for j in range(sample.shape[1])], axis=1)
        centres = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return np.unique(centres, axis=0)


def reach(queries: np.ndarray, query_at: np.ndarray, sample: np.ndarray, centres: np.ndarray, near: int, recall: float) -> float:
    """How much farther than its nearest centre a query's probed centres may be, in squared distance, to hold the wanted share of near vectors.

    Learnt from sample rows that play queries: the quantile, over them and each one's nearest other sample rows, of the
    distance to the neighbour's centre less that to the nearest one. Data in clusters need little, uniform data much.
    """
    own = np.concatenate([squared(sample[at : at + 2048], centres).argmin(axis=1) for at in range(0, len(sample), 2048)])
    excess = []
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        d = squared(q, sample)
        d[np.arange(len(q)), query_at[at : at + 64]] = np.inf
        found = np.argpartition(d, near - 1, axis=1)[:, :near]
        c = squared(q, centres)
        excess.append((np.take_along_axis(c, own[found], axis=1) - c.min(axis=1)[:, None]).ravel())
    return float(np.quantile(np.concatenate(excess), recall, method="higher"))


def lifted(matrix: np.ndarray, top: float | None) -> np.ndarray:
    """Vectors with one more component: what they lack of the greatest squared norm (0 for queries, top None).

    The nearest of lifted vectors to a lifted query by distance is the one of greatest inner product.
    """
    more = np.zeros(len(matrix)) if top is None else np.sqrt(np.maximum(top - (matrix * matrix).sum(axis=1), 0))
    return np.hstack([matrix, more[:, None]])


def scan_list(q: np.ndarray, x: np.ndarray, bar: np.ndarray, doubt: float) -> np.ndarray:
    """Squared distances of rotated queries to a list's rotated vectors, infinite where given up.

    Column block after column block is added. After d of D columns a pair is given up if its partial
    distance, scaled to D columns, would refute at the chosen doubt that the whole is within the query's bar. While many
    pairs are left whole blocks are multiplied; few are followed pair by pair.
    """
    dims = x.shape[1]
    total = np.zeros((len(q), len(x)))
    at = 0
    while at < dims:
        here = slice(at, min(at + COLUMNS, dims))
        alive = np.isfinite(total)
        if alive.mean() >= SPARSE or at == 0:
            total += squared(q[:, here], x[:, here])
        else:
            i, j = np.nonzero(alive)
            total[i, j] += ((q[i, here] - x[j, here]) ** 2).sum(axis=1)
        at = here.stop
        if at < dims:
            limit = bar * (at / dims) * (1 + doubt / math.sqrt(at)) ** 2
            total[total > limit[:, None]] = np.inf
    return total


def best_of(q: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k of highest score of their query, ties to smaller ids; in that order, query by query."""
    order = np.lexsort((ids, -scores, q))
    return order[np.arange(len(q)) - np.searchsorted(q[order], q[order], side="left") < k]


def search_lists(
    q: np.ndarray, q_ids: np.ndarray, probes: list[np.ndarray], x: np.ndarray, x_ids: np.ndarray, x_list: np.ndarray, top: float, turn: np.ndarray, k: int, doubt: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best found in the lists it probes, which lie in x; a query's own rows are no candidates."""
    moved, queries = lifted(x, top) @ turn, lifted(q, None) @ turn
    best = np.full((len(q), k), np.inf)
    asked = np.concatenate(probes) if probes else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own in np.unique(x_list):
        members, everyone = np.flatnonzero(x_list == own), np.unique(owner[asked == own])
        for at in range(0, len(everyone), QUERY_BLOCK):
            who = everyone[at : at + QUERY_BLOCK]
            d = scan_list(queries[who], moved[members], best[who, -1] * (1 + 1e-9) + 1e-12, doubt)
            d[q_ids[who][:, None] == x_ids[members][None, :]] = np.inf
            merged = np.concatenate([best[who], d], axis=1)
            best[who] = np.sort(np.partition(merged, k - 1, axis=1)[:, :k], axis=1)
            i, j = np.nonzero(np.isfinite(d) & (d <= best[who, -1][:, None] * (1 + 1e-9) + 1e-12))
            i, j = who[i], members[j]
            score = np.concatenate([np.empty(0), *((q[i[b : b + 65_536]] * x[j[b : b + 65_536]]).sum(axis=1) for b in range(0, len(i), 65_536))])
            kept = best_of(i, score, x_ids[j], k)  # so that many copies of one vector stay few
            found.append((i[kept], j[kept], score[kept]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    i, j, score = (np.concatenate(c) for c in zip(*found))
    kept = best_of(i, score, x_ids[j], k)
    return i[kept], j[kept], score[kept]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 20_000,
    recall: float = 0.97,
    doubt: float = 1.5,
    seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest inner product found, nearest first, ties to smaller vec_id.

    Candidates are all vectors but the query's own (told by id). The index: k-means centres fitted on at most sample_rows
    vectors (those of smallest hashed id), four times the square root of the vector count of them; every vector goes to its nearest
    centre's list. A query probes the lists whose centres are hardly farther than its nearest one, how much is learnt from
    sample rows so that the lists hold the share recall of their near vectors (`reach`): few lists where vectors lie in clusters, about
    half of them where they are uniform. It goes on to further lists until they hold k candidates. Only lists that hold vectors
    count. Vectors are rotated at random, so any columns are a fair sample of all; lists are scanned by column blocks, and a
    hypothesis test on the partial distance gives up candidates early (doubt: the test's width; greater gives up less). Scores of what is
    left are the inner products of the original vectors in double precision.

    Lists are packed into or split over groups of GROUP_ROWS vectors, queries into groups of GROUP_QUERIES, so no list, however
    many copies it holds, makes one large task. Vectors null, empty, zero or holding null or non-finite
    components take no part, nor rows with a null id. Each query is searched among vectors of its own length; the INDEXED_LENGTHS most frequent
    lengths have an index each, vectors of all others are searched exactly. Query rows that share an id and a vector are one query; those that share an id alone have
    k candidates each under it. A query with fewer candidates than k gets all of them. Repeated ids are candidates each. Other columns are
    not read. Empty tables give an empty result. The index is built when this is called.
    """
    rows, asked = usable(vectors, id_col, vector_col, zero=False), distinct_queries(usable(queries, id_col, vector_col, zero=False))
    length = F.size("v")
    indexed = [r["n"] for r in rows.groupBy(length.alias("n")).count().orderBy(F.desc("count"), "n").limit(INDEXED_LENGTHS + 1).collect()]
    parts = [_nearest(rows.where(length == n), asked.where(length == n), n, k, sample_rows, recall, doubt, seed) for n in indexed[:INDEXED_LENGTHS]]
    if not 0 < len(indexed) <= INDEXED_LENGTHS:
        rest = ~length.isin(indexed[:INDEXED_LENGTHS])
        parts.append(in_blocks(rows.where(rest), asked.where(rest), lambda q, q_ids, x, x_ids: scan_all(q, q_ids, x, x_ids, k), "double"))
    return ranked(reduce(DataFrame.union, parts), k)


def scan_all(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best, all pairs compared, a few queries at a time; a query's own rows are no candidates."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(q), 64):
        i, j = np.nonzero(q_ids[at : at + 64, None] != x_ids[None, :])
        score = np.concatenate([np.empty(0), *((q[at + i[b : b + 65_536]] * x[j[b : b + 65_536]]).sum(axis=1) for b in range(0, len(i), 65_536))])
        kept = best_of(i, score, x_ids[j], k)
        found.append((at + i[kept], j[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _nearest(rows: DataFrame, asked: DataFrame, dims: int, k: int, sample_rows: int, recall: float, doubt: float, seed: int) -> DataFrame:
    """(query_id, key, vec_id, score) found among vectors of one length, of which there are some."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    count, top = rows.agg(F.count("*"), F.max(norm)).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    plain = sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
    fit = lifted(plain, top)
    centres = centroids(fit, max(1, min(MAX_LISTS, round(4 * math.sqrt(count)), -(-len(fit) // 8))), seed)
    lists = len(centres)
    near = max(1, min(len(fit) - 1, round(k * len(fit) / count)))  # as near in the sample as the k nearest of all
    some = min(PSEUDO_QUERIES, len(fit))
    bound = reach(lifted(plain[:some], None), np.arange(some), fit, centres, near, recall) if len(fit) > 1 else 0.0
    held = np.zeros(lists, np.int64)  # vectors of each list, counted below
    turn = rotation(dims + 1, seed)

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = squared(lifted(matrix(batch.column(1)), top), centres).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], ["vec_id", "v", "list"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared(lifted(matrix(batch.column(1)), None), centres)
            d[:, held == 0] = np.inf
            order = d.argsort(axis=1, kind="stable").astype(np.int32)
            within = (d <= d.min(axis=1)[:, None] + bound).sum(axis=1)
            enough = k + batch.column(3).to_numpy()  # a query's own rows are no candidates
            wide = np.minimum(np.maximum(within, 1 + (held[order].cumsum(axis=1) < enough[:, None]).sum(axis=1)), (held > 0).sum())
            chosen = [row[:n] for row, n in zip(order, wide)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chosen, pa.list_(pa.int32()))], ["vec_id", "v", "key", "lists"])

    assigned = durable(rows.mapInArrow(assign, "vec_id long, v array<double>, list int").withColumn("nth", F.monotonically_increasing_id()))
    sizes = assigned.groupBy("list").count().orderBy("list").collect()  # at most MAX_LISTS rows
    for own, size in sizes:
        held[own] = size
    groups_of, group, room = [], 0, GROUP_ROWS
    for own, size in sizes:
        parts = -(-size // GROUP_ROWS)
        if parts > 1 or size > room:
            group, room = group + 1, GROUP_ROWS
        groups_of.append((own, list(range(group, group + parts))))
        group, room = (group + parts, GROUP_ROWS) if parts > 1 else (group, room - size)
    kinds = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("groups", T.ArrayType(T.IntegerType()))])
    packed = spark.createDataFrame(groups_of, kinds)
    query_groups = max(1, -(-asked.count() // GROUP_QUERIES))

    own_rows = assigned.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    chosen = asked.join(own_rows, "vec_id", "left").select("vec_id", "v", "key", F.coalesce("own", F.lit(0)).cast("long").alias("own"))
    probing = durable(chosen.mapInArrow(choose, "vec_id long, v array<double>, key long, lists array<int>").withColumn("part", F.pmod(F.xxhash64("vec_id", "key"), F.lit(query_groups))))
    aims = durable(probing.select("vec_id", "key", "part", F.explode("lists").alias("list")).join(packed, "list"))
    # a list goes only to the groups of queries of which one probes it
    wanted = aims.select("list", F.col("part").alias("for")).distinct()
    placed = assigned.join(packed, "list").join(wanted, "list").select(
        F.element_at("groups", (F.pmod(F.xxhash64("vec_id", "nth"), F.size("groups")) + 1).cast("int")).alias("in"), "for", F.col("vec_id").alias("vec_id"), "v", "list"
    )
    met = aims.select("vec_id", "key", "part", "list", F.explode("groups").alias("grp")).groupBy("vec_id", "key", "part", "grp").agg(F.collect_set("list").alias("lists"))
    sent = met.join(probing.select("vec_id", "key", "v"), ["vec_id", "key"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [*[np.empty(0, np.int64)] * 3, np.empty(0)]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by([("vec_id", "ascending"), ("key", "ascending")]), right.sort_by("vec_id")
            q, q_ids, x, x_ids = matrix(left.column("v")), left.column("vec_id").to_numpy(), matrix(right.column("v")), right.column("vec_id").to_numpy()
            probes = [np.array(p) for p in left.column("lists").to_pylist()]
            i, j, score = search_lists(q, q_ids, probes, x, x_ids, right.column("list").to_numpy(), top, turn, k, doubt)
            parts = [q_ids[i], left.column("key").to_numpy()[i], x_ids[j], score]
        return pa.table(parts, names=["query_id", "key", "vec_id", "score"])

    return sent.groupBy("part", "grp").cogroup(placed.groupBy("for", "in")).applyInArrow(search, "query_id long, key long, vec_id long, score double")
