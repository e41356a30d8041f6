"""Cross-tokenizer alignment against token-by-token loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from campovia.llm import queries, token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(texts):
    """What each text's row must hold: all pairs of token spans are tried."""
    kit = token_align.TwoTokenizers(open(A, "rb").read(), open(B, "rb").read())
    docs, count = [], Counter()
    for text in texts:
        body = text or ""
        a = kit.a.encode(" " + body, add_special_tokens=False).ids
        b = kit.b.encode(body)
        pieces = [bytes([int(p[3:-1], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in map(kit.b.id_to_piece, b)]
        if not body or b"".join(kit.a_bytes[i] for i in a) != (" " + body).encode() or b"".join(pieces) != (" " + body).encode():
            docs.append(([], [], [], ""))
            continue
        sa, sb = spans([len(kit.a_bytes[i]) for i in a]), spans(map(len, pieces))
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        count.update(links)
        groups, start = [], 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            side = lambda ids, s: ",".join(str(i) for i, (x, y) in zip(ids, s) if start <= x and y <= end)  # noqa: E731, B023
            groups.append(f"{side(a, sa)}|{side(b, sb)}")
            start = end
        docs.append((a, b, links, ";".join(groups)))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for a, b, links, g in docs
    ]


TEXTS = [
    "The cat sat on the mat.", "the  cat\n\n sat", None, "", " ", "▁x is taken for a space", "naïve café – 漢字 😀😀", "<|endoftext|> <s> </s><unk>", "a\x00b\tc\r\n", "ﬁ ﬂ é é", "The cat sat on the mat.",
    "x" * 300, "12345 678,90", "  odd spaces ", "internationalisation antidisestablishmentarianism",
]


def test_alignment(spark):
    rows = [(i % 9 if i != 4 else None, t, "x", "y") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, `a.b` string").repartition(3)
    documents, pairs = token_align.align(df, A, B)
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256 groups".split()
    got = Counter((r.doc_id, *(r[c] for c in names)) for r in documents.collect())
    assert got == Counter((row[0], *w) for row, w in zip(rows, brute(TEXTS)))
    assert sum(r["count"] for r in pairs.collect()) == sum(w[3] for w in brute(TEXTS))
    best = {r.b: r["count"] for r in pairs.where("best_of_b").collect()}
    assert all(r["count"] <= best[r.b] for r in pairs.collect())


def test_empty_and_other_ids(spark):
    df = spark.createDataFrame([("k", "some text")], "doc_id string, text string")
    assert token_align.align(df, A, B)[0].first()[:2] == ("k", 2)
    documents, pairs = token_align.align(df.limit(0), A, B)
    assert documents.count() == pairs.count() == 0 and documents.columns[0] == "doc_id"


def test_chunks_of_any_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(token_align, "CALL_CHARS", 40)
    monkeypatch.setattr(token_align, "CHUNK_CHARS", 60)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    chunks = token_align.link_chunks(docs, open(A, "rb").read(), open(B, "rb").read(), "doc_id", "text", True)
    assert chunks.select("chunk").distinct().count() >= 3
    got = {r.doc_id: r.groups_sha256 for r in token_align.align(docs, A, B)[0].collect()}
    assert [got[i] for i in range(len(TEXTS))] == [w[6] for w in brute(TEXTS)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where(F.length("text") < 3000).orderBy("doc_id").collect()
    wanted = {r.doc_id: w for r, w in zip(texts, brute([r.text for r in texts]))}
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all((got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links, got[i].groups_sha256) == (*w[:4], w[6]) for i, w in wanted.items())


def test_text_that_is_no_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'plain words'")
    got = {r.doc_id: r for r in token_align.align(df, A, B)[0].collect()}
    assert got[1].n_links == got[1].count_sum == 0 and got[1].groups_sha256 == "" and got[2].n_links > 0


def test_segments_are_encoded_as_in_the_whole():
    """Encoding segment by segment gives what encoding the whole gives, for any mixture of spaces, marks and letters."""
    import random

    kit = token_align.TwoTokenizers(open(A, "rb").read(), open(B, "rb").read())
    draw = random.Random(3)
    for _ in range(1500):
        text = "".join(draw.choice("  \t\n\u00a0\u3000▁ab'sé1.漢\x1c") for _ in range(draw.randint(1, 30)))
        segments = kit.segments(" " + text)
        assert "".join(segments) == " " + text
        side_a, side_b, covered = kit.encode(segments[-1:] + segments)  # a row of segments need not be a text
        if covered.all():
            for got, of, size in ((side_a, kit.a.encode(" " + text, add_special_tokens=False).ids, kit.a_size), (side_b, kit.b.encode(text), kit.b_size)):
                assert got[np.cumsum(size[got]) > covered[0]].tolist() == of
