"""Near-duplicates by exact Jaccard similarity of word shingles; SimHash deletion variants only find where to compare."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.llm.components import connected_components
from campovia.llm.simhash_dedup import WORD, _mixed, _ones, close_pairs, word_columns
from campovia.session import durable, give_back

#: A set's SimHash has WORDS * 64 bits, of which two sets of Jaccard similarity 0.8 differ in 29.1 on average, with a spread of 5 (the
#: cosine of sets of one size is 0.889). They meet where one of the EACH segments of a word differs by at most a bit: with 12 segments of 16
#: bits a pair at 0.8 exactly does so with a probability of 0.98, at 0.85 of 0.996, at 0.9 of 0.9998. LOOSE_BITS is over three spreads above that average.
WORDS, EACH, LOOSE_BITS = 3, 4, 46
#: Shingles of the sets that are compared in one task, about.
COMPARED = 4_000_000


def shingles(text: bytes, width: int, seed: int) -> np.ndarray:
    """The different shingles' hashes of a UTF-8 text, sorted: A-Z lower-cased, width words between ASCII white space, fewer in a shorter text."""
    tokens = text.lower().split()
    reach = min(width, len(tokens))
    if not reach:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    first = np.concatenate([[0], ends[:-reach]]).tolist()
    last = (ends[reach - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], np.uint64))


def set_simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of hashes, none twice, as 64-bit words."""
    ones = np.stack([_ones(_mixed(hashes, k)) for k in range(words)])
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(doc, print, own, size, w0, w1, ...): hashes of the text and of its shingle set, the set's size (0 where the text is null or blank) and its SimHash."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            bits = np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                found = shingles(text.as_py() or b"", width, seed)
                if len(found):
                    own[i], sizes[i], bits[i] = xxhash.xxh64_intdigest(found.tobytes(), seed), len(found), set_simhash(found, WORDS)
            words = (pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(WORDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.view(np.int64)), pa.array(sizes), *words], ["doc", "print", "own", "size", *word_columns(WORDS)])
        give_back()

    kinds = ", ".join(f"{c} long" for c in word_columns(WORDS))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, print long, own long, size long, {kinds}")


def similar_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first index of each set's component, sets being linked where the Jaccard similarity is at least the given one.

    Breadth first over sets not yet reached: each is compared with the reached ones once, exactly, so a dense group costs little.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    rest = np.flatnonzero(sizes)
    if len(rest) < 2:
        return root
    values, flat = np.unique(np.concatenate([sets[i] for i in rest]), return_inverse=True)
    flat = flat.astype(np.int32)
    edges = np.concatenate([[0], np.cumsum(sizes[rest])])
    places = {int(i): flat[a:b] for i, a, b in zip(rest, edges, edges[1:])}
    held, starts = rest, edges[:-1]  # whose places lie in flat, and where
    open_ = np.zeros(len(sets), bool)
    open_[rest] = True
    mark = np.zeros(len(values), bool)
    for first in rest:
        if not open_[first]:
            continue
        open_[first] = False
        front = [int(first)]
        while front:
            probe = front.pop()
            left = open_[held]
            if left.sum() * 2 < len(held):
                held = held[left]
                if not len(held):
                    return root
                flat = np.concatenate([places[int(i)] for i in held])
                starts = np.concatenate([[0], np.cumsum(sizes[held])[:-1]])
                left = np.ones(len(held), bool)
            mark[places[probe]] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[places[probe]] = False
            near = held[left & (shared >= similarity * (sizes[held] + sizes[probe] - shared))]
            open_[near] = False
            root[near] = first
            front += near.tolist()
    return root


def verified(contested: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """(own, root, blocks): exact links among the rows (loose, left, right, blocks, own, body) of one loose, left and right, each set to the first of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets = None, [], []

        def done() -> pa.RecordBatch:
            own = np.array(names, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[similar_roots(sets, similarity)]), pa.array([last[3]] * len(own), pa.int64())], ["own", "root", "blocks"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for key, own, body in zip(keys, batch.column(4).to_pylist(), batch.column(5).cast(pa.binary())):
                if key != last:
                    if names:
                        yield done()
                    last, names, sets = key, [], []
                if not names or names[-1] != own:
                    names.append(own)
                    sets.append(shingles(body.as_py() or b"", width, seed))
        if names:
            yield done()
        names.clear()
        sets.clear()
        give_back()

    dealt = contested.select("loose", "left", "right", "blocks", "own", "body").repartition("loose", "left", "right").sortWithinPartitions("loose", "left", "right", "own")
    return dealt.mapInArrow(run, "own long, root long, blocks long")


def similar_groups(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, seed: int) -> DataFrame:
    """(doc, print, component_id), one row for each row of docs.

    Texts of one shingle set are merged. Sets whose SimHashes meet under a deletion variant and are at most LOOSE_BITS bits apart form
    loose components; within each the sets are compared exactly, and only that makes links. A loose component of more than
    COMPARED shingles is dealt in blocks, of which each two are compared in a task of their own, so that none holds more; the blocks' links
    are joined afterwards. Null and blank texts have the empty set, which is similar to itself alone.
    """
    marked = durable(sketches(docs, id_col, text_col, width, seed))
    some = F.first(F.struct("size", *word_columns(WORDS)))
    sets = durable(marked.groupBy("own").agg(F.min("doc").alias("first"), F.min(F.struct("doc", "print")).alias("pick"), some.alias("s")).select("own", "first", "pick", "s.*"))
    prints = sets.where("size > 0").select(*word_columns(WORDS)).distinct()
    links = connected_components(close_pairs(prints, LOOSE_BITS, WORDS, EACH), "a", "b")
    node = F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in word_columns(WORDS)))
    placed = sets.where("size > 0").select("own", "pick", "size", node.alias("node")).join(links, "node", "left").select("own", "pick", "size", F.coalesce("root", "node").alias("loose"))
    several = placed.groupBy("loose").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / COMPARED).alias("blocks")).where("n > 1").drop("n")
    wanted = placed.join(several, "loose").withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")))
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("block"))))
    pairs = wanted.select("loose", "blocks", "own", F.col("pick.doc").alias("id"), F.col("pick.print").alias("hash"), "block", other.alias("other"))
    pairs = pairs.select("loose", "blocks", "own", "id", "hash", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("body"))
    contested = texts.join(pairs, F.col("doc").eqNullSafe(F.col("id")) & (F.col("print") == F.col("hash")))
    exact = durable(verified(contested, width, similarity, seed))
    joined = connected_components(exact.where("blocks > 1"), "own", "root").select(F.col("node").alias("own"), "root")
    roots = exact.where("blocks = 1").select("own", "root").union(joined)
    rooted = sets.select("own", "first").join(roots, "own", "left").select("own", "first", F.coalesce("root", "own").alias("root"))
    component = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = rooted.join(component, "root").select("own", "component_id")
    return marked.select("doc", "print", "own").join(by_set, "own", "left").select("doc", "print", "component_id")
