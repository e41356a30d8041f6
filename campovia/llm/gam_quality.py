"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campovia.session import give_back

#: Bins of a feature's table and of either side of a pair's; interactions kept; rounds over all tables; step; least weight of a leaf.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAST = 48, 12, 8, 160, 60, 0.1, 5.0
FEATURES = (
    "log_words mean_word distinct_words repeated_next top_word upper bars bangs symbols digits wide_bytes stops log_line repeated_lines spaces long_words one_letter"
).split()


def _classes() -> np.ndarray:
    """For each byte: 0 other, 1 upper-case letter, 2 lower-case letter, 3 bar, 4 exclamation mark, 5 symbol, 6 digit, 7 beyond ASCII, 8 stop, 9 white space."""
    kind = np.zeros(256, np.int64)
    for name, members in ((1, range(65, 91)), (2, range(97, 123)), (3, b"|"), (4, b"!"), (5, b"#$%&*+<=>@[\\]^_`{}~/"), (6, b"0123456789"), (7, range(128, 256)), (8, b".,;:?"), (9, b" \t\n\r\v\f")):
        kind[list(members)] = name
    return kind


KINDS = _classes()


def features(text: bytes) -> list[float]:
    """The features of one whole text, each defined for the empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    counts = np.bincount(KINDS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 10)
    seen = Counter(words)
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters = counts[1] + counts[2] + 1
    return [
        float(np.log1p(n)), float(lengths.mean()), len(seen) / n ** 0.9, sum(map(eq, words, words[1:])) / n, max(seen.values()) / n,
        counts[1] / letters, counts[3] / n, counts[4] / n, counts[5] / n, counts[6] / size, counts[7] / size, counts[8] / n,
        float(np.log1p(size / len(filled))), 1 - len(set(filled)) / len(filled), counts[9] / size, float((lengths > 20).mean()), float((lengths == 1).mean()),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    """The features of many texts."""
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    """Cut points and a lookup table for each feature and each kept pair; a score is the logistic of their sum."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of all tables at the rows' bins."""
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        coarse = [np.searchsorted(cut, x[:, j], side="right") for j, cut in enumerate(self.pair_cuts)]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between quantiles: at most bins - 1."""
    found = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (found[1:] + found[:-1]) / 2 if len(found) > 1 else np.empty(0)


def gains(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a leaf of these gradient and weight sums takes off the loss, twice; too light leaves are barred."""
    return np.where(h >= LEAST, g * g / (h + 1), -np.inf)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over one feature's bins, as a table of steps."""

    def cut(lo: int, hi: int) -> int | None:
        if hi - lo < 2:
            return None
        left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gains(left_g, left_h) + gains(all_g - left_g, all_h - left_h)
        at = int(gain.argmax())
        return lo + at + 1 if gain[at] > all_g * all_g / (all_h + 1) else None

    steps = np.zeros(len(g))
    first = cut(0, len(g))
    edges = [0, len(g)] if first is None else [0, first, len(g)]
    for lo, hi in zip(edges, edges[1:]):
        second = cut(lo, hi) if first is not None else None
        for a, b in zip(*(([lo, second], [second, hi]) if second is not None else ([lo], [hi]))):
            steps[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return steps


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on either side of a pair: its gain and its table of steps."""
    if min(g.shape) < 2:
        return -np.inf, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    gain = sum(gains(x, y) for x, y in zip(*parts))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            steps[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gain[i, j]) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1), steps


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learn from rows of features and labels 0 or 1.

    Round after round each feature in turn gets a shallow tree fitted to the present gradients of the logistic loss,
    added to its table; then the pairs of largest remaining gain are chosen and boosted in the same way. Without rows, or
    with one label only, every score is the label's smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    cuts = [cut_points(x[:, j], BINS) for j in range(width)] if len(x) else [np.empty(0)] * width
    coarse_cuts = [cut_points(x[:, j], PAIR_BINS) for j in range(width)] if len(x) else [np.empty(0)] * width
    model = Gam(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse_cuts, [], [])
    if len(x) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse_cuts)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            n = len(model.tables[j])
            steps = RATE * shallow_tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += steps
            total += steps[bins[j]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(coarse_cuts[a]) + 1, len(coarse_cuts[b]) + 1
        cell = coarse[a] * shape[1] + coarse[b]
        g, h = slopes()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(width), 2), key=lambda ab: -quadrants(*grid(*ab))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(coarse_cuts[a]) + 1, len(coarse_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            gain, steps = quadrants(*grid(a, b))
            if gain > 0:
                model.pair_tables[k] += RATE * steps
                total += RATE * steps[coarse[a], coarse[b]]
    return model


def held_out(id_column: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000
) -> Gam:
    """Fit the model on at most sample_rows labelled documents that are not held out: those of smallest hashed id.

    The sample's ids, at most sample_rows, are broadcast to the documents; only their features reach the driver. Null
    labels and ids are left out; labels other than 0 count as 1.
    """
    known = labels.select(F.col(id_col).alias("doc"), (F.col(label_col) != 0).cast("int").alias("label")).where("doc IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc"))).orderBy(F.xxhash64("doc"), "doc", "label").limit(sample_rows)
    bodies = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["doc", "x", "label"])

    kind = bodies.schema["doc"].dataType.simpleString()
    seen = bodies.join(F.broadcast(known), "doc").mapInArrow(run, f"doc {kind}, x array<double>, label int")
    rows = seen.orderBy(F.xxhash64("doc"), "doc", "label", "x").limit(sample_rows).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows.column("label").to_numpy().astype(float))


def scored(docs: DataFrame, model: Gam, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs, all columns and rows, with the score of each whole text in a column out, in place of one of that name; null texts score as empty ones."""
    docs = docs.drop(out)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(matrix([t or b"" for t in batch.column(at).slice(i, 512).cast(pa.binary()).to_pylist()])) for i in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())], [*names, out])
        give_back()

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on, else 0).

    Every row is kept; null and empty texts are scored as empty ones; repeated rows score alike; the label tables, ids and
    other columns are no inputs. Columns of docs called score or predicted are replaced. An empty table gives an empty result.
    """
    return scored(docs.drop("predicted"), model, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
