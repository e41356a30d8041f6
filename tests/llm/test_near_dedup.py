"""The pipeline's near-dedup against brute-force Jaccard similarity of five-word shingles."""

from test_texts import brute_lines

import corpus_pipeline
from campovia.llm import gam_quality

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text: str) -> set[tuple[str, ...]]:
    words = [w.decode() for w in text.encode().lower().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(rows: list[tuple[int, str]]) -> set[int]:
    sets = {d: shingle_set(t) for d, t in sorted(rows)}
    seen: set[int] = set()
    kept = set()
    for d in sets:
        if d in seen:
            continue
        kept.add(d)
        front = [d]
        seen.add(d)
        while front:
            x = sets[front.pop()]
            near = [e for e, y in sets.items() if e not in seen and similarity(x, y) >= 0.8]
            seen.update(near)
            front += near
    return kept


def changed(words: list[str], places: range) -> str:
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_pairs_on_both_sides_of_the_bound(spark):
    """Two changed words of 100 leave 0.811 and three 0.730: the fingerprint's distance alone parts neither well."""
    rows = []
    for n in range(60):
        words = [f"d{n}w{i}" for i in range(100)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, changed(words, range(20, 60, 20)))]
        other = [f"d{n}v{i}" for i in range(100)]
        rows += [(10 * n + 2, " ".join(other)), (10 * n + 3, changed(other, range(20, 80, 20)))]
    assert 0.8 < similarity(shingle_set(rows[0][1]), shingle_set(rows[1][1])) < 0.82 and 0.7 < similarity(shingle_set(rows[2][1]), shingle_set(rows[3][1])) < 0.75
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()}
    assert got == kept_ids(rows) == {d for d, _ in rows if d % 10 != 1}


def test_check_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()} == kept_ids(rows)


def test_run_with_exact_similarity(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = gam_quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in docs.collect() if model.score(gam_quality.matrix([r.text.encode()]))[0] >= 0.5]
    cut = [(d, t) for d, t, _ in brute_lines(kept)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == kept_ids(cut)
