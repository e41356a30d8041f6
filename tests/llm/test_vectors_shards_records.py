"""Searches, sharding, fixity and the quality classifier."""

import bisect
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from campovia.llm import ann_adaptive, exact_topk, feistel_shards, gam_quality, queries, vectors, warc_fixity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, rank string"


def brute(ids, x, asked, k):
    out = []
    for q in asked:
        for i in np.flatnonzero(ids == q):
            score = (x * x[i]).sum(1)
            others = np.flatnonzero(ids != q)
            best = others[np.lexsort((ids[others], -score[others]))][:k]
            out += [(int(q), n, int(ids[j]), float(score[j])) for n, j in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 16))
    x[100:400] = x[7]  # copies of one vector
    ids = np.arange(700)
    good = [(int(i), [float(c) for c in v], "k") for i, v in zip(ids, x)]
    bad = [(900, None, "k"), (920, [None] * 16, "k"), (940, [float("nan")] * 16, "k"), (960, [float("inf")] + [0.0] * 15, "k"), (980, [1.0], "k"), (None, [1.0] * 16, "k"), (1000, [], "k")]
    return spark.createDataFrame(good + bad, SCHEMA), ids, x


def test_exact_topk(cloud, monkeypatch):
    df, ids, x = cloud
    monkeypatch.setattr(vectors, "CANDIDATES", 150)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    monkeypatch.setattr(vectors, "QUERY_BLOCKS", 2)
    got = sorted((r.query_id, r.rank, r.vec_id, float(r.score)) for r in exact_topk.exact_topk(df, df.where("vec_id % 20 = 0"), k=20).collect() if r.query_id < 900)
    assert got == brute(ids, np.floor(64 * x), ids[ids % 20 == 0], 20)


def test_exact_topk_small_and_large(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], ""), (20, [1e5, -1e5], ""), (1, [3e4, 2e4], "")], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.exact_topk(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 1, 64 * 64 * 10**9), (20, 2, 0, 0)]
    assert exact_topk.exact_topk(df.limit(0), df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e12, 1e12], ""), (1, [1e12, 1e12], "")], SCHEMA)
    with pytest.raises(Exception, match="2 \\*\\* 53"):
        exact_topk.exact_topk(huge, huge).collect()


def test_lists_are_read_no_further_than_they_decide():
    """Few candidates stand out: a hundredth of the entries is read, and the scores are those of a full product."""
    rng = np.random.default_rng(1)
    block = rng.integers(0, 4, (8000, 5)).astype(float)
    block[:30] = 100 + np.arange(150).reshape(30, 5)
    q, c, score, depths = exact_topk.search_block(block[:9], -1 - np.arange(9), block, np.arange(8000), 20)
    assert (depths <= 80).all()
    assert all(c[q == i].tolist() == list(range(29, 9, -1)) for i in range(9)) and (score == (block[q] * block[c]).sum(1)).all()
    heavy = np.round(np.exp(1.5 * rng.standard_normal((5000, 6))) * 8)  # long tails: the heads of the lists decide
    q, c, score, depths = exact_topk.search_block(heavy[:40], np.arange(40), heavy, np.arange(5000), 20)
    assert depths.mean() < 0.5 * 5000
    want = brute(np.arange(5000), heavy, range(40), 20)
    assert [(w[0], w[2], w[3]) for w in want] == list(zip(q.tolist(), c.tolist(), score.tolist()))


def test_exact_topk_by_length(spark):
    df = spark.createDataFrame([(20 * i, [1.0 * i, 2.0], "") for i in range(4)] + [(20 * i + 7, [1.0], "") for i in range(3)] + [(1000, [3.0], "")], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in exact_topk.exact_topk(df, df.where("vec_id % 20 = 0"), k=2).collect())
    assert got[:2] == [(0, 1, 20), (0, 2, 40)] and got[-2:] == [(1000, 1, 7), (1000, 2, 27)] and len(got) == 10
    many = spark.createDataFrame([(i, [1.0] * i, "") for i in range(1, 30)], SCHEMA)
    assert exact_topk.exact_topk(many, many).count() == 0  # every vector is the only one of its length


def test_nearest_recall_and_scores(cloud, monkeypatch):
    df, ids, x = cloud
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    monkeypatch.setattr(ann_adaptive, "GROUP_ROWS", 64)
    monkeypatch.setattr(ann_adaptive, "GROUP_QUERIES", 16)
    monkeypatch.setattr(ann_adaptive, "reach", lambda *_: float("inf"))
    everywhere = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann_adaptive.nearest(df, df.where("vec_id % 20 = 0"), k=20, doubt=9.0).collect() if r.query_id < 900)
    assert [w[:3] for w in want] == [g[:3] for g in everywhere] and np.allclose([w[3] for w in want], [g[3] for g in everywhere])


def test_nearest_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    want = {(w[0], w[2]) for w in brute(ids, x, ids[ids % 20 == 0], 20)}
    got = queries.op4_ann_adaptive(spark, folder).collect()
    assert len(got) == len(want) and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


def test_nearest_edges(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], ""), (20, [1.0, 2.0], ""), (1, [2.0, 1.0], ""), (1, [2.0, 1.0], "")], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann_adaptive.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(20, 1, 1, 4.0), (20, 2, 1, 4.0)]
    assert ann_adaptive.nearest(df.limit(0), df.limit(0)).count() == 0 and ann_adaptive.nearest(df.where("vec_id = 20"), df.where("vec_id = 20")).count() == 0


def test_scan_gives_up_only_what_it_may():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((500, 65)), rng.standard_normal((4, 65))
    d = ann_adaptive.squared(q, x)
    bar = np.sort(d, axis=1)[:, 20]
    scanned = ann_adaptive.scan_list(q, x, bar, 3.0)
    kept = np.isfinite(scanned)
    assert np.allclose(scanned[kept], d[kept]) and not kept.all() and (kept | (d > bar[:, None])).mean() > 0.99


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 101, 4097])
def test_places_are_a_permutation(spark, n):
    assert sorted(r[0] for r in spark.range(n).select(feistel_shards.place(F.col("id"), n, 7)).collect()) == list(range(n))


def test_shards(spark):
    rows = [(i, f"t{i}") for i in range(500)] + [(1, "t1")] * 400 + [(None, None), (None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    got = feistel_shards.shard_rows(df, ["doc_id", "text"], 7)
    pdf = got.toPandas()
    sizes = pdf.groupby("shard").size()
    assert len(pdf) == 902 and sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in pdf.groupby("shard"))
    again = feistel_shards.shard_rows(df.repartition(13), ["doc_id", "text"], 7)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert (pdf["place"] == pdf.slot * 7 + pdf.shard).all() and pdf[pdf.doc_id == 1]["place"].std() > 100
    assert feistel_shards.shard_rows(df.limit(0), ["doc_id"], 7).count() == 0
    with pytest.raises(ValueError):
        feistel_shards.shard_rows(df, ["shard"])


def test_shard_query(spark, tmp_path):
    pdf = queries.op9_feistel_shards(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    assert dict(zip(pdf.doc_id, zip(pdf["size"], pdf.text_crc32))) == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in zip(docs.doc_id, docs.text)}
    assert pdf.groupby("shard").size().max() - pdf.groupby("shard").size().min() <= 1 and (pdf.law == "rows").all() and pdf.grown_shard.isna().all()
    feistel_shards.write_shards(queries.op9_feistel_shards(spark, FOLDER), str(tmp_path / "shards"))
    one = spark.read.parquet(str(tmp_path / "shards" / "shard=3")).toPandas()
    assert one.slot.tolist() == list(range(len(one)))


def test_warc_round_trip_and_audit(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{'é' * i}</p>", "k") for i in range(40)] + [(None, None, None, "k"), (3, "http://x/3", "dup", "k")], "page_id long, url string, html string, file string")
    records = warc_fixity.to_records(pages, file_records=10)
    assert records.count() == 42 and records.select("file").distinct().count() == 5
    warc_fixity.write_warc(records, str(tmp_path / "w"))
    back = warc_fixity.read_warc(spark.read.parquet(str(tmp_path / "w")))
    key = lambda df: sorted((r.file, r.record, bytes(r["data"])) for r in df.collect())
    assert key(back) == key(records)
    own, other = warc_fixity.leaves_of_records(records), warc_fixity.leaves_of_records(back)
    assert warc_fixity.audit(own, other, 10)[0].count() == 0
    assert sorted(map(str, warc_fixity.leaves_of_pages(pages, file_records=10).drop("id").select("file", "node", "start", "stop", "hash").collect())) == sorted(map(str, own.select("file", "node", "start", "stop", "hash").collect()))
    hurt = F.when((F.col("file") == 2) & (F.col("record") == 4), F.lit(b"?")).otherwise(F.col("data"))
    broken = back.withColumn("data", hurt).where("NOT (file = 1 AND record = 9)").where("file <> 3")
    faults, roots = warc_fixity.audit(own, warc_fixity.leaves_of_records(broken), 10)
    got = {(r.file, r.node): r.fault for r in faults.collect()}
    lost = {(3, n): "missing_in_b" for n in range(10)}
    assert got == {(2, 4): "altered", **{(2, n): "moved" for n in range(5, 10)}, (1, 9): "missing_in_b", **lost}
    assert roots.count() == 5 and warc_fixity.audit(own.limit(0), other.limit(0))[0].count() == 0


def test_merkle_root_by_hand(spark):
    leaf = [(0, i, 10 * i, 10 * i + 10, hashlib.sha256(bytes([i])).hexdigest()) for i in range(20)]
    def up(nodes):
        out = []
        for at in range(0, len(nodes), 16):
            kids = nodes[at : at + 16]
            out.append((kids[0][0], kids[-1][1], hashlib.sha256("\n".join(f"{a} {b} {h}" for a, b, h in kids).encode()).hexdigest()))
        return out
    root = up(up([x[2:] for x in leaf]))
    tree = warc_fixity.merkle(spark.createDataFrame(leaf, "file long, node long, start long, stop long, hash string"), 2)
    assert [tuple(r)[2:] for r in tree[2].collect()] == [tuple(r) for r in root]


def test_quality_learns_and_holds_out(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op7_gam_quality(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    good = both.quality == 1
    assert (both.predicted == both.quality).mean() > 0.99 and both[good].predicted.mean() > 0.99 and (1 - both[~good].predicted).mean() > 0.95


def test_quality_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    wrong = labels.withColumn("quality", F.when(gam_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (gam_quality.learn(docs, x) for x in (labels, wrong))
    x = gam_quality.matrix([b"some words here", b"!! !! !!", b""])
    assert (a.score(x) == b.score(x)).all()


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam_quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.93


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b c", "x"), (3, "w " * 100_000, "x")], "doc_id long, text string, label string")
    none = gam_quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = gam_quality.classify(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    one = gam_quality.learn(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, None), (None, 0)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in gam_quality.classify(docs, one).collect())
    assert gam_quality.classify(docs.limit(0), one).count() == 0
    clash = gam_quality.classify(docs.withColumn("score", F.lit(1)).withColumn("predicted", F.lit("x")), one)
    assert clash.columns == ["doc_id", "text", "label", "score", "predicted"] and all(r.predicted == 1 for r in clash.collect())  # replaced


def plain_features(text: str) -> list[float]:
    """The classifier's features, written out once more without arrays."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * 17
    n, size = len(words), len(raw)
    count = lambda members: sum(raw.count(bytes([b])) for b in members)
    filled = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = count(range(65, 91)), count(range(97, 123))
    return [
        math.log(1 + n), sum(map(len, words)) / n, len(set(words)) / n**0.9, sum(a == b for a, b in zip(words, words[1:])) / n, max(words.count(w) for w in set(words)) / n,
        upper / (upper + lower + 1), count(b"|") / n, count(b"!") / n, count(b"#$%&*+<=>@[\\]^_`{}~/") / n, count(b"0123456789") / size, count(range(128, 256)) / size, count(b".,;:?") / n,
        math.log(1 + size / len(filled)), 1 - len(set(filled)) / len(filled), count(b" \t\n\r\v\f") / size, sum(len(w) > 20 for w in words) / n, sum(len(w) == 1 for w in words) / n,
    ]


def test_quality_query_against_sums_of_tables(spark):
    """Every score of the query is the logistic of table entries looked up one by one, for features counted in another way."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = gam_quality.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op7_gam_quality(spark, FOLDER).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = plain_features(r.text or "")
        total = model.base + sum(t[bisect.bisect_right(c.tolist(), v)] for c, t, v in zip(model.cuts, model.tables, x))
        for (a, b), table in zip(model.pairs, model.pair_tables):
            total += table[bisect.bisect_right(model.pair_cuts[a].tolist(), x[a])][bisect.bisect_right(model.pair_cuts[b].tolist(), x[b])]
        score = 1 / (1 + math.exp(-min(60, max(-60, total))))
        mine = got[r.doc_id]
        assert abs(mine.score - score) < 1e-6 and mine.predicted == (mine.score >= 0.5) and mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_boosting_lowers_the_loss_as_a_plain_stump_does():
    """The first step of the first table is the gradient step of the best two-level tree, found by trying all of them."""
    rng = np.random.default_rng(12)
    g, h = rng.standard_normal(9), rng.uniform(6, 9, 9)
    got = gam_quality.shallow_tree(g, h)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    best = lambda a, b: max(range(a + 1, b), key=lambda m: gain(a, m) + gain(m, b))
    first = best(0, 9)
    edges = [0]
    for a, b in ((0, first), (first, 9)):
        if b - a > 1 and gain(a, best(a, b)) + gain(best(a, b), b) > gain(a, b):
            edges.append(best(a, b))
        edges.append(b)
    want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(edges, edges[1:])])
    assert np.allclose(got, want)


def plain_place(number: int, rows: int, seed: int) -> int:
    """The Feistel permutation and its walk in plain numbers."""
    left_size = max(1, math.isqrt(rows))
    right_size = -(-rows // left_size)

    def keyed(value: int, key: int) -> int:
        state = 42
        for data in (value.to_bytes(8, "little"), seed.to_bytes(4, "little"), key.to_bytes(4, "little")):
            state = xxhash.xxh64_intdigest(data, state)
        return state - 2**64 if state >= 2**63 else state

    while True:
        left, right = divmod(number, right_size)
        for k in range(feistel_shards.ROUNDS):
            left = (left + keyed(right, 2 * k) % left_size) % left_size
            right = (right + keyed(left, 2 * k + 1) % right_size) % right_size
        number = left * right_size + right
        if number < rows:
            return number


@pytest.mark.parametrize("n", [1, 7, 100, 1003])
def test_places_against_plain_numbers(spark, n):
    got = {r[0]: r[1] for r in spark.range(n).select("id", feistel_shards.place(F.col("id"), n, 42)).collect()}
    assert got == {i: plain_place(i, n, 42) for i in range(n)}


def test_shard_query_against_plain_numbers(spark, monkeypatch):
    """Rows numbered by bucket and value, permuted in plain numbers, and dealt in turn."""
    monkeypatch.setattr(feistel_shards, "BUCKET_ROWS", 50)
    got = queries.op9_feistel_shards(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    digests = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    kinds = digests.distinct().count()
    keyed = digests.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "crc"), F.lit(-(-kinds // 50)))).toPandas().sort_values(["bucket", "doc_id", "size", "crc"])
    want = {d: divmod(plain_place(i, len(keyed), 42), 16) for i, d in enumerate(keyed.doc_id)}
    assert {d: (slot, shard) for d, slot, shard in zip(got.doc_id, got.slot, got.shard)} == want


def test_pages_without_ids_are_dealt_by_url(spark):
    pages = spark.range(500).selectExpr("CAST(NULL AS long) AS page_id", "concat('http://x/', id) AS url", "'<p>' AS html")
    leaves = warc_fixity.leaves_of_pages(pages)
    assert leaves.count() == 500 and leaves.where("file >= 0").count() == 0 and leaves.groupBy("file").count().agg(F.max("count")).first()[0] <= 3


def by_vector(table, k, scale=None):
    """(query_id, rank, vec_id, score) of every different query row; rows (id, vector), equal lengths only."""
    out = []
    good = [(i, tuple(math.floor(scale * c) for c in v) if scale else tuple(v)) for i, v in table]
    for q, v in sorted({(i, v) for i, v in good if i % 20 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -score) for n, (score, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("operator", [ann_adaptive.nearest, exact_topk.exact_topk])
def test_repeated_queries_and_many_lengths(spark, operator):
    """A copied query row gets k different candidates once; another row of its id k of its own; twenty lengths in one table."""
    rng = np.random.default_rng(5)
    table = [(i, [float(c) for c in rng.integers(-9, 9, i % 20 + 1)]) for i in range(400)]
    table = [(i, v if any(v) else [1.0] * len(v)) for i, v in table]
    table += [table[20], table[40], (60, [3.0]), (60, [float(c) for c in rng.integers(1, 9, 7)]), table[7], table[7]]
    df = spark.createDataFrame([(i, v, "x") for i, v in table], SCHEMA).repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in operator(df, df.where("vec_id % 20 = 0"), k=6).collect())
    assert got == by_vector(table, 6, None if operator is ann_adaptive.nearest else 64)
