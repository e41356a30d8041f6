"""Personal data: base spans against the plain patterns, the estimate of reliabilities, what is added."""

import hashlib
import random
import re

import numpy as np

from campovia.llm import queries, weak_pii
from campovia.llm.weak_pii import CARD, EMAIL, IP, KINDS, PHONE

PLAIN = {
    EMAIL: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    IP: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    CARD: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    PHONE: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            if {EMAIL: True, IP: max(map(int, m.group().split("."))) <= 255 if kind == IP else None, CARD: 12 <= len(digits) <= 19 and doubled % 10 == 0, PHONE: 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_of_any_text():
    draw = random.Random(7)
    parts = ["@", ".", "a", "b-c", "1", "255", "256", "4111111111111111", "+", "+1 (555) 010-9999", " ", "-", "_", "é", "x@y.z", "(", ")", "10.0.0.1", "4111 1111 1111 1111", "\n", "０", "٣", "5" * 25]
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert weak_pii.proposals(text)[0] == plain(text), text


def test_long_runs_take_no_square_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000, "(123) " * 50_000, "a at " * 50_000):
        base, others = weak_pii.proposals(text)
        assert len(base) + len(others) < 100_001


def test_reliabilities_are_found():
    """Votes drawn from known reliabilities: the truth is told apart, and a labeler that guesses is seen through."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.6
    votes = []
    for right, some in ((0.95, 0.9), (0.9, 0.9), (0.8, 0.6), (0.85, 0.4), (0.5, 0.9)):
        told = np.where(rng.random(len(truth)) < right, truth, ~truth)
        votes.append(np.where(rng.random(len(truth)) < some, np.where(told, "y", "n"), "-"))
    rows = ["".join(v) for v in zip(*votes)]
    patterns = [(CARD, False, p, rows.count(p)) for p in sorted(set(rows))]
    priors, table = weak_pii.reliabilities(patterns)
    assert abs(priors[CARD] - 0.6) < 0.03
    assert (np.abs(table[:, 1, 0] - [0.95, 0.9, 0.8, 0.85, 0.5]) < 0.06).all()
    belief = weak_pii.posterior(np.full(len(rows), CARD), weak_pii.as_numbers(rows), priors, table)
    assert ((belief > 0.5) == truth).mean() > 0.95


def test_find(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} {word()} mail {word()}@{word()}.com or call phone +1 (212) 555-0{draw.randint(100, 999)} {word()} from 10.2.{i % 250}.9 card 4111111111111111 {word()}") for i in range(300)]
    rows += [(1000 + i, f"{word()} order {draw.randint(10**15, 10**16)} {word()}") for i in range(100)]
    extra = [(2000, "please call phone (212) 555-0188 today"), (2001, "write mail to jane (at) corp (dot) com"), (2002, "version 999.1.2.3 of build 1.2.3"), (2003, None), (2004, ""), (None, "jane@corp.com"), (2005, "x"), (2005, "x"), (2006, "é😀 jane@corp.com")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows + extra], "doc_id long, text string, spans string, `a.b` int").repartition(4)
    got = {(r.doc_id, i): r for i, r in enumerate(weak_pii.find(df).collect())}
    assert len(got) == len(rows) + len(extra)
    by_id = {i: r for (i, _), r in got.items()}
    for i, text in rows + [e for e in extra if e[0] is not None]:
        assert [(s.start, s.kind, s.end) for s in by_id[i].base] == plain(text or "")
    assert [(s.kind, s.start, s.end) for s in by_id[2006].base] == [(EMAIL, 3, 16)]
    assert [(s.kind, s.start, s.end) for s in by_id[2000].added] == [(PHONE, 18, 32)]
    assert not by_id[2002].added and not any(by_id[1000 + i].added for i in range(100))  # numbers that fail their rules are no finds
    assert by_id[2003].base == by_id[2004].base == [] and len(by_id[None].base) == 1
    assert weak_pii.find(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_weak_pii(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = plain(texts[r.doc_id] or "")
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and [r[f"n_{k}"] for k in KINDS] == [sum(b[1] == n for b in base) for n in range(4)]
        assert set(line.split(",")) - {""} <= set(r.spans.split(",")) and len([s for s in r.spans.split(",") if s]) == len(base) + r.n_added
