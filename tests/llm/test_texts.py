"""Line dedup, byte-level BPE, packing and chat formatting."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import connect, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from campovia.llm import byte_bpe, line_dedup, packing, preference_format, queries

FOLDER = "/root/testdata/sf0.001"
ODD = [
    " lead", "trail ", "a  b   c\n\n d \t e", "x 　 y", "don't  we'll 's 'S. x", "a\x1cb \x1c c", "  ", "", None, "\n", "é é ́ x", "İ İ ΑΣ Σ. T̈", "<|endoftext|> x<|startoftext|>",
    "日本語 テスト 한국어", "a" * 5000, " " * 3000 + "x", "1234567 12 3", "﻿x ​ y", "😀 👍🏽!!", "\x01 a\x01b x.", "Hey... ok, yes., no.. 3.5, 4.", "word " * 60_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "y"), (0, " lead", "x")], "doc_id long, text string, ids string")


def brute_lines(docs):
    """(id, text) -> kept text, by the definition: lines of later windows go, lines of a repeated window's first occurrence stay."""
    places, out = {}, []
    ordered = sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0]))
    for d, text in ordered:
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip(" \t\n\x0b\f\r"):
                places.setdefault(window, []).append((d, i))
    later = {(d, i + k) for at in places.values() for d, i in at[1:] for k in range(3)}
    first = {(at[0][0], at[0][1] + k) for at in places.values() if len(at) > 1 for k in range(3)}
    gone = later - first
    for d, text in docs:
        if text is None:
            out.append((d, None, 0))
            continue
        lines = text.split("\n")
        out.append((d, "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone), sum((d, i) in gone for i in range(len(lines)))))
    return out


def test_line_dedup_against_brute_force(spark):
    docs = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb\nc"), (4, "a\nb"), (5, None), (6, ""), (7, "\n\n\n\n"), (8, "r\nr\nr\nr\nr"), (9, "p\n" * 3000 + "q"),
        (10, "\t\n\t\n\t\n\t"), (11, " \n\t\n\r\n\x0b\n \n\t\n\r"), (12, "u\nv\nu\nv\nu\nv\nu"), (13, "r\nr\nr\nr"), (14, "\u3000\n\u3000\n\u3000\n\u3000"), (None, "a\nb\nc\nz"),
    ]
    kinds = "doc_id long, text string, at string, gone string, body string, rest string, count string"
    df = spark.createDataFrame([(*d, *"kgbrc") for d in docs], kinds)
    got = line_dedup.remove_repeated_windows(df)
    assert got.columns == [*df.columns, "removed_lines"] and all(tuple(r)[2:7] == tuple("kgbrc") for r in got.collect())
    mine = {r.doc_id: (r.text, r.removed_lines) for r in got.collect()}
    assert mine[8] == ("r\nr\nr", 2) and mine[12] == ("u\nv\nu\nv", 3) and mine[13] == ("", 4) and mine[10] == ("\t\n\t\n\t\n\t", 0)
    assert sorted([(r.doc_id, r.text, r.removed_lines) for r in got.collect()], key=str) == sorted(brute_lines(docs), key=str)
    assert line_dedup.remove_repeated_windows(df.limit(0)).count() == 0
    again = line_dedup.remove_repeated_windows(got)
    assert again.columns == got.columns
    twice = line_dedup.remove_repeated_windows(df.where("doc_id = 1").union(df.where("doc_id = 1"))).collect()
    assert [r.removed_lines for r in twice] == [0, 0]  # rows equal in id and text are one document


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    ours = queries.queries()[name](spark, FOLDER).toPandas()
    assert rows(ours) == rows(connect(FOLDER).execute(queries.oracle_sql()[name]).fetchdf())


def test_byte_bpe_is_the_library(spark, odd):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert sorted([(r.doc_id, bytes(r["data"]).decode()) for r in got], key=str) == sorted(want, key=str)
    expected = {t: library.encode_ordinary(t) for _, t in want}
    for r in got:
        assert r.ids == np.frombuffer(bytes(r.packed), "<u4").tolist() == expected[bytes(r["data"]).decode()]
    assert byte_bpe.encode(odd.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    for outside in (2**24, 50256, -1):
        with pytest.raises(Exception, match="not in the vocabulary"):
            byte_bpe.decode(spark.createDataFrame([(1, [outside])], "doc_id long, ids array<int>"), ranks).collect()
    some = byte_bpe.decode(spark.createDataFrame([(1, None, "x"), (2, [], "y")], "row long, ids array<int>, tokens string"), ranks).collect()
    assert [(r.row, r["data"], r.tokens) for r in some] == [(1, None, "x"), (2, b"", "y")]


def test_byte_bpe_of_one_text_and_of_nulls(spark, monkeypatch):
    """Copies of one text, and rows without any, are chunks of their own: none meets another's words, none is lost."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 100)
    monkeypatch.setattr(byte_bpe, "CHUNK_ROWS", 50)
    same = spark.range(0, 3000, 1, 8).selectExpr("id AS doc_id", "'the same text, again and again' AS text")
    nulls = spark.range(3000, 6000, 1, 8).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text")
    chunks = byte_bpe.positions(same.union(nulls), "doc_id", "text", public_tokenizers.PATTERN).toPandas()
    assert chunks.chunk.is_unique and chunks.sizes.map(len).max() <= 50
    got = byte_bpe.encode(same.union(nulls), ranks, public_tokenizers.PATTERN).selectExpr("ids", "doc_id < 3000 AS given").toPandas()
    assert len(got) == 6000 and got.ids[~got.given].map(len).max() == 0
    assert got.ids[got.given].map(tuple).nunique() == 1 and got.given.sum() == 3000


def test_each_distinct_word_has_one_part(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 20_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chunks = byte_bpe.positions(docs, "doc_id", "text", public_tokenizers.PATTERN)
    lists = byte_bpe.dealt(chunks, 37).toPandas()
    part_of = {}
    for part, blob in zip(lists.part, lists.words):
        for word in byte_bpe.items(blob):
            assert part_of.setdefault(word, part) == part
    assert lists.groupby("chunk").words.agg(lambda b: sum(len(byte_bpe.items(x)) for x in b)).to_dict() == chunks.toPandas().set_index("chunk")["count"].to_dict()


def test_byte_bpe_chunks_do_not_matter(spark, monkeypatch):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(byte_bpe, "PART_WORDS", 500)
    small = {r.doc_id: bytes(r.packed) for r in byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    monkeypatch.undo()
    assert small == {r.doc_id: bytes(r.packed) for r in byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    query = {r.doc_id: r for r in queries.op3_byte_bpe(spark, FOLDER).collect()}
    for d, ids in small.items():
        assert (query[d].n_tokens, query[d].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
    assert {d: r.decoded_sha256 for d, r in query.items()} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}


def test_first_fit_takes_the_first_bin_with_room():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 333):
        sizes = sorted(rng.integers(1, 101, n).tolist(), reverse=True)
        free, want = [], []
        for s in sizes:
            b = next((i for i, f in enumerate(free) if f >= s), len(free))
            if b == len(free):
                free.append(100)
            want.append((b, 100 - free[b]))
            free[b] -= s
        assert packing.first_fit(sizes, 100) == want
    assert packing.first_fit([], 100) == []


def test_packing(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(odd, path).toPandas()
    seen = sorted(np.concatenate([np.frombuffer(bytes(i), "<u4") for i in p.sort_values("start").ids]).tolist() for _, p in got[got.doc_id.notna() & (got.doc_id > 0)].groupby("doc_id"))
    assert seen == sorted(library.encode(t or "", add_special_tokens=False).ids + [1] for t in ODD[1:])
    assert (got.ids_crc32 == [zlib.crc32(bytes(i)) for i in got.ids]).all() and (got.length == [len(i) // 4 for i in got.ids]).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert got.doc_id.isna().sum() == 1 and (got.doc_id == 0).sum() == 2
    assert packing.pack(odd.limit(0), path).count() == 0
    laid = packing.sequences(packing.pack(odd, path)).toPandas()
    assert (laid.ids.map(len) == 2048).all() and laid.used.sum() == got.length.sum()


def test_packing_query_piece_by_piece(spark):
    """All pieces of the query against the library: each document cut up whole, each sequence filled without gaps, first-fit decreasing in each group."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op10_packing(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    ids_of = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in zip(docs.doc_id, docs.text)}
    want = set()
    for d, ids in ids_of.items():
        want |= {(d, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)}
    assert set(zip(got.doc_id, got.start, got.length, got.ids_crc32, got.doc_tokens)) == want and len(got) == len(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    for _, group in got.groupby(got.sequence_id // 2**32):
        bins: list[int] = []
        for n in sorted(group.length, reverse=True):
            at = next((i for i, used in enumerate(bins) if used + n <= 2048), len(bins))
            bins[at:at + 1] = [(bins[at] if at < len(bins) else 0) + n]
        assert sorted(bins) == sorted(group.groupby("sequence_id").length.sum())


def test_packing_wastes_little(spark):
    got = queries.op10_packing(spark, FOLDER).toPandas()
    assert got.length.sum() > 0.97 * 2048 * got.sequence_id.nunique()
    whole = got.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (whole.n == whole.t).all() and len(whole) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_preferences(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, None, None, None), (3, 0, "user", "x"), (4, 0, "user", "only chosen"), (None, 0, "user", "n")]
    other = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (2, 2, "user", "more"), (3, None, None, None), (None, 0, "user", "n")]
    frame = lambda t: spark.createDataFrame([(*x, "k") for x in t], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.conv_id: r for r in preference_format.preference_examples(frame(turns), frame(other)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].chosen == "<|assistant|>\ngood<|end|>\n" and got[1].rejected == "<|assistant|>\nbad<|end|>\n"
    assert got[1].chosen_mask == "14:0 12:1" and sum(int(x.split(":")[0]) for x in got[1].chosen_mask.split()) == len(got[1].chosen)
    assert got[2].prompt_turns == 2 and got[2].chosen == "" and got[2].chosen_mask == "" and got[2].rejected.startswith("<|user|>")
    assert got[3].prompt_turns == 1 and got[3].rejected == ""
    assert preference_format.preference_examples(frame(turns).limit(0), frame(other)).count() == 0


def test_repeated_turns_count(spark):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert preference_format.preference_examples(t, t).select(F.col("prompt_turns")).first()[0] == 2
