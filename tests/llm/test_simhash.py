"""SimHash near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash

from campovia.llm import queries, simhash_dedup
from campovia.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"


def fingerprint(text: str, width: int) -> int:
    """The contract word for word."""
    words = [w.decode() for w in (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, values, most):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, values):
            for b, y in zip(ids, values):
                if bin(x ^ y).count("1") <= most and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_query_is_the_contract(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, FOLDER).collect()}
    prints = [fingerprint(t, 4) for t in docs.text]
    assert {i: g[0] for i, g in got.items()} == {i: f"{p:016x}" for i, p in zip(docs.doc_id, prints)}
    assert {i: g[1] for i, g in got.items()} == components(list(docs.doc_id), prints, 4)


@pytest.mark.parametrize(("words", "max_bits", "count"), [(1, 4, 300), (2, 19, 200), (1, 0, 50), (1, 1, 60), (2, 7, 120)])
def test_no_close_pair_is_lost(spark, words, max_bits, count):
    rng = np.random.default_rng(words * 100 + max_bits)
    base = rng.integers(0, 2**63, (count, words), dtype=np.uint64)
    near = base[rng.integers(0, count, count)].copy()
    for row in near:
        for bit in rng.choice(64 * words, max_bits + rng.integers(0, 2), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    every = np.unique(np.concatenate([base, near]), axis=0)
    fps = spark.createDataFrame([tuple(int(x) for x in row.view(np.int64)) for row in every], ", ".join(f"w{k} long" for k in range(words)))
    links = simhash_dedup.close_pairs(fps, max_bits, words)
    roots = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    name = ["".join(f"{int(x):016x}" for x in row) for row in every]
    value = [int(n, 16) for n in name]
    label = list(range(len(value)))
    for i in range(len(value)):
        for j in range(i):
            if bin(value[i] ^ value[j]).count("1") <= max_bits and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    for i in range(len(value)):
        for j in range(i):
            assert (label[i] == label[j]) == (roots.get(name[i], name[i]) == roots.get(name[j], name[j]))


def test_dense_bucket_sends_few_links():
    rng = np.random.default_rng(3)
    values = np.full((1, 3000), 12345, np.uint64)
    for i in range(3000):
        values[0, i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64)) | np.uint64(1) << np.uint64(rng.integers(0, 64))
    values = np.unique(values, axis=1)
    a, b = simhash_dedup.spanning_links(values, None, 4)
    assert len(a) == values.shape[1] - 1
    nodes, roots = simhash_dedup.rooted(values[:, a].T, values[:, b].T)
    assert len(nodes) == values.shape[1] - 1 and len(np.unique(roots)) == 1


def test_edges(spark):
    long = "w " * 50_000
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "one two", "d"), (5, "ONE\ttwo", "e"), (None, "one two", "f"), (4, "one two", "d"), (6, long, "g"), (7, long, "h"), (None, "lone text of null id here", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (4, 4), (6, 6), (7, 6), (None, None)], key=str)
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted([docs.collect()[i] for i in (0, 3, 7, 9)], key=str)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS a", "(id + 1) AS b").union(spark.range(1).selectExpr("1000L AS a", "1000L AS b"))
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(301)}
    assert connected_components(edges.limit(0), "a", "b").count() == 0
