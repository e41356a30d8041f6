"""Hard-negative mining: stored distances to pivots bracket every score, only what the brackets leave is checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.llm.ann_adaptive import best_of
from campovia.llm.vectors import usable
from campovia.session import durable, give_back

#: Rows of a candidate block, anchors of a group; rows of a tile and anchors that meet it at once.
BLOCK_ROWS, GROUP_ANCHORS, TILE_ROWS, TILE_ANCHORS = 8192, 1024, 1024, 256
#: Pivots of vectors of one length, and the rows from which they are chosen (those of smallest hashed id).
PIVOTS, SAMPLE_ROWS = 16, 4096
#: Share of a tile's pairs above which their scores come from one matrix product.
DENSE = 1 / 16


def augmented(x: np.ndarray, top: float | None) -> np.ndarray:
    """Vectors with one more component: what a row lacks of the greatest squared norm, top; 0 for anchors (None).

    Then |a - x| ** 2 = |a| ** 2 + top - 2 * score: the score falls as the distance grows.
    """
    more = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
    return np.hstack([x, more[:, None]])


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to count different sample rows, each the farthest from those before it."""
    chosen, away = [0], np.sqrt(((sample - sample[0]) ** 2).sum(axis=1))
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(axis=1)))
    return sample[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors to the pivots."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.empty((len(x), 0))


def brackets(square: np.ndarray, anchor: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score that an anchor can have with rows whose distances to each pivot lie between nearest and farthest.

    By the triangle inequality over every pivot. square: the anchors' squared norms; anchor: their distances to the pivots. Wider by more than rounding can do.
    """
    close, far = np.zeros((len(anchor), len(nearest))), np.full((len(anchor), len(nearest)), np.inf)
    for p in range(anchor.shape[1]):
        own = anchor[:, p, None]
        np.maximum(close, np.maximum(own - farthest[None, :, p], nearest[None, :, p] - own), out=close)
        np.minimum(far, own + farthest[None, :, p], out=far)
    whole = (square + top)[:, None]
    slack = 0.25 + 1e-11 * whole
    return (whole - far * far) / 2 - slack, (whole - close * close) / 2 + slack


def scores_of(a: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the wanted pairs."""
    i, j = np.nonzero(wanted)
    if len(i) > DENSE * wanted.size:
        return i, j, (a @ x.T)[i, j]
    return i, j, np.concatenate([np.empty(0), *((a[i[s : s + 65_536]] * x[j[s : s + 65_536]]).sum(axis=1) for s in range(0, len(i), 65_536))])


class Side:
    """Anchors or rows of one vector length in a task: ids, labels, vectors, distances to pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, d: np.ndarray, place: np.ndarray):
        self.ids, self.labels, self.x, self.d, self.place = ids, labels, x, d, place

    def take(self, which: np.ndarray) -> Side:
        """Some of them."""
        return Side(self.ids[which], self.labels[which], self.x[which], self.d[which], self.place[which])


def best_in_bands(anchors: Side, low: np.ndarray, high: np.ndarray, rows: Side, same_label: bool, top: float, k: int) -> tuple[list[np.ndarray], int]:
    """[anchor, band, row, score] of the k best rows in every band of scores (low to high) of every anchor, ties to smaller ids; and how many pairs were checked exactly.

    Rows have the anchor's label or another one (same_label), and not its id. They are laid out by their nearest pivot
    in tiles; a tile, then a row, is left out where its bracket says that it is in no band or below all that the bands hold by now.
    """
    order = np.lexsort((rows.d.min(axis=1), rows.d.argmin(axis=1))) if rows.d.shape[1] else np.arange(len(rows.ids))
    rows = rows.take(order)
    starts = np.arange(0, len(rows.ids), TILE_ROWS)
    nearest, farthest = (f.reduceat(rows.d, starts, axis=0) for f in (np.minimum, np.maximum))
    square, bands, checked = (anchors.x * anchors.x).sum(axis=1), low.shape[1], 0
    found: list[tuple[np.ndarray, ...]] = []
    for first in range(0, len(anchors.ids), TILE_ANCHORS):
        part = np.arange(first, min(first + TILE_ANCHORS, len(anchors.ids)))
        best = np.full((len(part), bands, k), -np.inf)
        tile_least, tile_most = brackets(square[part], anchors.d[part], nearest, farthest, top)
        for t in np.argsort(-tile_most.max(axis=0), kind="stable"):  # promising tiles raise the bars for the others
            tile = slice(starts[t], starts[t] + TILE_ROWS)
            bar = np.maximum(low[part], best[:, :, -1])
            need, most = bar.min(axis=1), high[part].max(axis=1)
            who = np.flatnonzero((tile_most[:, t] >= need) & (tile_least[:, t] <= most))
            if not len(who):
                continue
            own = part[who]
            at_least, at_most = brackets(square[own], anchors.d[own], rows.d[tile], rows.d[tile], top)
            able = (at_most >= need[who, None]) & (at_least <= most[who, None])
            able &= ((anchors.labels[own][:, None] == rows.labels[None, tile]) == same_label) & (anchors.ids[own][:, None] != rows.ids[None, tile])
            i, j, score = scores_of(anchors.x[own], rows.x[tile], able)
            checked += len(i)
            for band in range(bands):
                good = np.flatnonzero((score >= bar[who, band][i]) & (score <= high[own, band][i]))
                good = good[best_of(i[good], score[good], rows.ids[tile][j[good]], k)]
                if len(good):
                    new = np.full((len(who), k), -np.inf)
                    new[i[good], np.arange(len(good)) - np.searchsorted(i[good], i[good], side="left")] = score[good]
                    best[who, band] = -np.sort(-np.concatenate([best[who, band], new], axis=1), axis=1)[:, :k]
                    found.append((own[i[good]], np.full(len(good), band), j[good] + tile.start, score[good]))
    if not found:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0)], checked
    a, band, row, score = (np.concatenate(c) for c in zip(*found))
    kept = best_of(a * bands + band, score, rows.ids[row], k)
    return [anchors.place[a[kept]], band[kept], rows.place[row[kept]], score[kept]], checked


def sides(left: pa.Table, right: pa.Table) -> Iterator[tuple[Side, Side]]:
    """Anchors and rows of a task by the length of their vectors, labels as numbers."""
    names = pa.concat_arrays([c for t in (left, right) for c in t.column("label").cast(pa.string()).chunks]).dictionary_encode().indices.to_numpy()
    sizes = [t.column("v").combine_chunks().value_lengths().to_numpy() for t in (left, right)]
    for size in np.intersect1d(*sizes):
        out = []
        for t, own, labels in zip((left, right), sizes, np.split(names, [left.num_rows])):
            place = np.flatnonzero(own == size)
            part = t.take(pa.array(place))
            matrix = lambda name: part.column(name).combine_chunks().flatten().to_numpy().reshape(len(place), -1)  # noqa: E731, B023
            d = matrix("d") if part.column("d").combine_chunks().value_lengths().to_numpy().max() else np.empty((len(place), 0))
            out.append(Side(part.column("vec_id").to_numpy(), labels[place], matrix("v"), d, place))
        yield out[0], out[1]


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Components x become floor(scale * x); a score is the whole inner product with the anchor, higher first, ties to smaller ids.
    Anchors are the rows for which is_anchor holds. An anchor's positives are its first rows of the same label; for each
    the first rows of other labels are returned whose score is at least low_percent and at most high_percent of the positive's (a
    negative or, but for scores of 0, zero positive score leaves none).

    Every row gets one more component, after which the greatest score is the least distance (`augmented`), and its distances to PIVOTS
    pivots are stored in a table, written once. Two passes over it, for positives, then for negatives in the bands of scores that the positives
    set: blocks of rows and groups of anchors, both of bounded size and dealt by a hash, meet; distances to the pivots bracket every score by the
    triangle inequality, and only the survivors' scores are computed (`best_in_bands`). Blocks send at most the wanted number a band, and
    ranks over those make the result. No label, however frequent, and no vector, however often copied, makes a large task. Pivots
    are chosen from SAMPLE_ROWS rows; they decide how much is checked exactly, never what is found: vectors of a length that the sample lacks have no pivots.

    Rows with a null id, label or vector, an empty vector or null or non-finite components take no part. Only equally long vectors have a score.
    Rows that share the anchor's id are neither its positives nor its negatives. Repeated ids are candidates each; anchors that
    share an id each have their own answer under it, equal ones (id, label and vector) one. Scores must stay below 2 ** 53 in size, else the
    job ends with an error. Other columns are not read. Empty tables give an empty result. The pivots are chosen and positives found when this is called.
    """
    marked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    floored = usable(marked.where(F.col("label").isNotNull()), "vec_id", "v", True, ["label", "anchor"])
    rows = floored.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    count, asked, top = rows.agg(F.count("*"), F.count_if("anchor"), F.max(norm)).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return vectors.sparkSession.createDataFrame([], result)
    if top >= 2**53:  # no score passes the greatest squared norm
        raise OverflowError("scores may pass 2 ** 53")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow().column("v").to_pylist()
    pivots = {n: farthest_first(augmented(np.array([v for v in sample if len(v) == n]), top), PIVOTS) for n in {len(v) for v in sample}}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat, ends = v.flatten().to_numpy(), np.cumsum(v.value_lengths().to_numpy())
            row_d, anchor_d = [None] * len(v), [None] * len(v)
            size = np.diff(ends, prepend=0)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = flat[(ends[at] - n)[:, None] + np.arange(n)]
                for out, lack in ((row_d, top), (anchor_d, None)):
                    for i, d in zip(at, to_pivots(augmented(x, lack), pivots.get(n, np.empty((0, n + 1))))):
                        out[i] = d
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row_d, kind), pa.array(anchor_d, kind)], ["vec_id", "v", "label", "anchor", "d", "anchor_d"])

    stored = durable(rows.select("vec_id", "v", "label", "anchor").mapInArrow(measure, "vec_id long, v array<double>, label string, anchor boolean, d array<double>, anchor_d array<double>"))
    blocks, groups = -(-count // BLOCK_ROWS), -(-asked // GROUP_ANCHORS)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    place = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n))
    fresh = (F.col(c).alias(c) for c in ("vec_id", "v", "label", "d"))
    # dealt by the row's number in what was written, too: a row repeated many times is spread over all blocks
    right = stored.select(*fresh, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).alias("blk"), every(groups).alias("grp"))
    anchors = stored.where("anchor").select("vec_id", F.xxhash64("label", "v").alias("key"), "label", "v", F.col("anchor_d").alias("d")).dropDuplicates(["vec_id", "label", "v"])

    def search(asked_rows: DataFrame, same_label: bool, k: int) -> DataFrame:
        """(anchor_id, key, band, vec_id, score): the k best of every block for each anchor and band; asked_rows has arrays low and high of scores."""

        def meet(left: pa.Table, other: pa.Table) -> pa.Table:
            parts: list[list[np.ndarray]] = []
            for a, x in sides(left, other) if left.num_rows and other.num_rows else ():
                cuts = [(np.flatnonzero(a.labels == own), np.flatnonzero(x.labels == own)) for own in np.unique(a.labels)] if same_label else [(slice(None), slice(None))]
                low, high = (np.array(left.column(c).take(pa.array(a.place)).to_pylist(), float) for c in ("low", "high"))
                for some, of in cuts:
                    if len(x.ids[of]):
                        parts.append(best_in_bands(a.take(some), low[some], high[some], x.take(of), same_label, top, k)[0])
            i, band, j, score = (np.concatenate(c) for c in zip(*parts)) if parts else [np.empty(0, np.int64)] * 4
            i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
            give_back()
            return pa.table(
                [left.column("vec_id").take(i), left.column("key").take(i), pa.array(band, pa.int32()), other.column("vec_id").take(j), pa.array(score.astype(np.int64))], ["anchor_id", "key", "band", "vec_id", "score"]
            )

        spread = asked_rows.withColumn("ogrp", place(groups, 1)).withColumn("oblk", every(blocks))
        schema = "anchor_id long, key long, band int, vec_id long, score long"
        best = spread.groupBy("ogrp", "oblk").cogroup(right.groupBy("grp", "blk")).applyInArrow(meet, schema)
        order = Window.partitionBy("anchor_id", "key", "band").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    limit = lambda x: F.array(F.lit(x))
    firsts = search(anchors.withColumn("low", limit(float("-inf"))).withColumn("high", limit(float("inf"))), True, positives)
    firsts = durable(firsts.select("anchor_id", "key", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 100 * negative between low * positive and high * positive, in whole numbers; bands that a short list lacks hold nothing
    low = F.ceil(F.expr(f"CAST({low_percent} * positive_score AS DECIMAL(38, 0)) / 100")).cast("double")
    high = F.floor(F.expr(f"CAST({high_percent} * positive_score AS DECIMAL(38, 0)) / 100")).cast("double")
    held = firsts.groupBy("anchor_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct(low.alias("low"), high.alias("high"))))).alias("bands"))
    band = lambda n, side, none: F.coalesce(F.col("bands")[n][side], F.lit(none))
    asked_rows = anchors.join(held.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "key"]).select(
        "vec_id", "key", "label", "v", "d",
        F.array(*(band(n, "low", float("inf")) for n in range(positives))).alias("low"), F.array(*(band(n, "high", float("-inf")) for n in range(positives))).alias("high"),
    )
    found = search(asked_rows, False, negatives).join(firsts, ["anchor_id", "key", "band"])
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT row_number() OVER () AS anchor, * FROM (SELECT DISTINCT * FROM usable WHERE vec_id % 100 = 0)),
scored AS (
  SELECT a.anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM anchors a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5),
ranked AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
