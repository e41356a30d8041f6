"""Exact top-k by integer inner product: sorted lists are read in turn, score bounds decide, no random access."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.llm import vectors as vectors_of
from campovia.llm.vectors import distinct_queries, in_blocks, ranked, usable

#: Entries of each list read before the first look at the bounds, how much further each next look is, and candidates (times k)
#: among which scores are resolved.
FIRST_DEPTH, DEEPER, RESOLVED = 32, 2, 4


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, block_ids: np.ndarray, k: int, order: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k best of a block, ties to smaller ids, its own row left out; and each query's depth.

    No-random-access aggregation. Each dimension is a sorted list of the block's components, which queries with a positive weight
    there read from the top and the others from the bottom. All lists are read on together, a little further each time; what is
    read is added to the candidates' sums. A candidate's lower bound is its sum and the least its unread lists can hold,
    its upper bound its sum and its unread lists' frontiers. One whose upper bound is under the k-th best lower bound cannot
    qualify. A query ends when those that still can are few (RESOLVED * k) or the lists end; then their final scores are resolved, and the
    best are taken. Sums are whole numbers that the blocks' floating type holds exactly. order: the sorted lists, where the block has them already.
    """
    n, dims = block.shape
    order = np.argsort(block, axis=0, kind="stable") if order is None else order
    least, most = block[order[0], np.arange(dims)], block[order[-1], np.arange(dims)]
    gain, loss = np.maximum(queries, 0), np.minimum(queries, 0)
    live, depth = np.arange(len(queries)), 0
    sums = np.zeros((n, len(queries)), block.dtype)
    unread = np.ones((n, 2 * dims), block.dtype)  # from the top, and from the bottom
    own = block_ids[:, None] == query_ids[None, :]
    depths = np.empty(len(queries), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        last, depth = depth, min(n, max(FIRST_DEPTH, k, math.ceil(depth * DEEPER)))
        read = np.zeros_like(unread)
        for d in range(dims):
            for rows, side in ((order[n - depth : n - last, d], d), (order[last:depth, d], dims + d)):
                read[rows, side] = block[rows, d]
                unread[rows, side] = 0
        weights = np.hstack([gain[live], loss[live]])
        some = np.flatnonzero(read.any(axis=1))
        sums[some] += read[some] @ weights.T
        low = high = sums
        if depth < n:
            edge_top, edge_bottom = block[order[n - depth], np.arange(dims)], block[order[depth - 1], np.arange(dims)]
            low = sums + unread @ (weights * np.concatenate([least, most])).T
            high = sums + unread @ (weights * np.concatenate([edge_top, edge_bottom])).T
        mine = own[:, live]
        low = np.where(mine, -np.inf, low).astype(block.dtype)
        bar = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(live), -np.inf)
        able = (high >= bar) & ~mine
        ended = (able.sum(axis=0) <= RESOLVED * k) | (depth == n)
        c, q = np.nonzero(able & ended)
        score = np.concatenate([np.empty(0, block.dtype), *((queries[live[q[a : a + 65_536]]] * block[c[a : a + 65_536]]).sum(axis=1) for a in range(0, len(q), 65_536))])
        out.append((live[q], c, score))
        depths[live[ended]] = depth
        live = live[~ended]
        if ended.any():
            sums = sums[:, ~ended]
    q, c, score = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    order = np.lexsort((block_ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[best], c[best], score[best], depths


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of highest integer inner product, ties to smaller vec_id.

    Components x become floor(scale * x). vectors are the candidates, queries a stated set of rows of the same shape; a query's
    own row, told by its id, is no candidate. Candidates and queries are laid in blocks of bounded size that meet by block
    number; each pair of blocks is searched by reading the block's sorted lists (`search_block`), and the blocks' best are
    merged by a ranked union of at most k rows a query and block.

    Vectors null, empty or holding null or non-finite components take no part, nor rows with a null id; zero vectors do.
    Vectors of several lengths, however many, share the blocks; each query is searched among its own length. With fewer candidates than k all are returned. Repeated ids
    are candidates each. Query rows that share an id and a vector are one query; those that share an id alone have k candidates each under it. Scores must stay below 2 ** 53 in size, else the job ends with an error. Other columns are not
    read. Empty tables give an empty result.
    """
    floored = lambda df: usable(df, id_col, vector_col, zero=True).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))

    def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most = np.abs(q).max(axis=0) @ np.abs(x).max(axis=0)
        if most >= 2**53:
            raise OverflowError("scores may pass 2 ** 53")
        if most < 2**24:  # all sums are whole numbers that single precision holds exactly
            q, x = q.astype(np.float32), x.astype(np.float32)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(x), vectors_of.CANDIDATES):
            block = x[at : at + vectors_of.CANDIDATES]
            lists = np.argsort(block, axis=0, kind="stable")
            for start in range(0, len(q), vectors_of.QUERIES):
                part = slice(start, start + vectors_of.QUERIES)
                a, b, score, _ = search_block(q[part], q_ids[part], block, x_ids[at : at + len(block)], k, lists)
                found.append((start + a, at + b, score.astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*found))

    return ranked(in_blocks(floored(vectors), distinct_queries(floored(queries)), search, "long"), k)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT row_number() OVER () AS query, * FROM (SELECT DISTINCT * FROM usable WHERE vec_id % 20 = 0)),
scored AS (
  SELECT q.query, q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.v) = len(c.v) THEN list_inner_product(q.v, c.v) END AS BIGINT) AS score
  FROM queries q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
