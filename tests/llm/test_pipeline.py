"""The pipeline's stages, one by one and together."""

import public_tokenizers
from test_near_dedup import kept_ids
from test_texts import brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from campovia.llm import gam_quality

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(kept) <= seen and len(kept) == len(set(kept)), name
        seen = set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.collect()} == seen
    whole = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == seen


def test_planted_copies_leave_one(spark):
    words = [f"w{(7 * i * i + i) % 997}x{i}" for i in range(400)]
    near = words.copy()
    near[200] = "changed"
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(words), "en", "s", 0), (3, " ".join(near), "en", "s", 0), (4, " ".join(reversed(words)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()) == [1, 4]


def test_changed_lengths(spark):
    block = "l1 a\nl2 b\nl3 c"
    docs = spark.createDataFrame([(1, block, 14), (2, f"top\n{block}", 18)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_lines(spark, docs, FOLDER).collect()}
    assert got == {1: (block, 14), 2: ("top", 3)}


def test_run_against_brute_force(spark):
    """Scores from the model, line dedup by its definition, exact similarities of all pairs, and the tokenizer's own counts."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = gam_quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [row for row in rows if model.score(gam_quality.matrix([row[1].encode()]))[0] >= 0.5]
    cut = [(d, t) for d, t, _ in brute_lines(kept)]
    stay = kept_ids(cut)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in cut if d in stay}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want and 0 < len(want) < len(kept) < len(rows)


def test_odd_documents(spark):
    """Null and repeated rows, null ids and clashing columns go through all stages; an empty table gives an empty one."""
    text = " ".join(f"word{i % 40} and{i % 7}, then{i % 11}" for i in range(120)) + "."
    rows = [(1, text), (1, text), (2, text + " end"), (3, None), (None, text.upper()), (4, ""), (5, "x"), (6, text.replace("word", "other"))]
    names = "score predicted removed_lines _id _own _print rest row body own gone n_chars 0 none at0 others".split() + ["a.b", "x `y`", "others.at0"]
    docs = spark.createDataFrame([(*r, *([7] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join("`" + n.replace("`", "``") + "` long" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns and all(tuple(r)[2:-1] == (7,) * (len(names) - 1) for r in found.collect())
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    near = {(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()}
    assert near == {(1, text), (3, None), (5, "x"), (6, text.replace("word", "other"))}  # a null text and an empty one are alike
    assert corpus_pipeline.packed(spark, docs, FOLDER).count() >= len(rows)
    assert corpus_pipeline.packed(spark, docs.limit(0), FOLDER).count() == 0


def test_lengths_that_are_texts(spark):
    """A column n_chars that is no whole number stays as it is."""
    docs = spark.createDataFrame([(1, "l1 a\nl2 b\nl3 c", "many"), (2, "top\nl1 a\nl2 b\nl3 c", "few")], "doc_id long, text string, n_chars string")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_lines(spark, docs, FOLDER).collect()}
    assert got == {1: ("l1 a\nl2 b\nl3 c", "many"), 2: ("top", "few")}
