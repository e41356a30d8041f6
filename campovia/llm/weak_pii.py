"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campovia.session import durable, give_back

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Groups of equal spans (kind, votes, features) that the classifier learns from at most, those of smallest hash.
TRAIN_GROUPS = 20_000
#: Characters before and after a span in which context is looked for.
BEFORE, AFTER = 40, 24

# Base patterns, written so that no start is tried twice over the same run of characters; what they match is that of
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, of four dotted numbers, of digits with single separators and of + and a number.
AT, DOMAIN, LOCAL = re.compile("@"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
BASE_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
BASE_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
BASE_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What may be personal data in another form.
SPELT_AT = re.compile(r" ?[(\[{](?:at|arroba)[)\]}] ?| (?:at|arroba) ", re.I)
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{](?:dot|punkt|punto|point|ponto)[)\]}] ?| (?:dot|punkt|punto|point|ponto) )[A-Za-z0-9-]{1,63}){1,4}", re.I)
SPELT_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
LONG_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)[ .-]?|00[0-9]{1,3}[ .-]|[0-9]{3}[ .-](?=[0-9]{3}[ .-][0-9]{4}))[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}(?![0-9])")

# Gazetteers: ends of domain names, first digits of card issuers, country calling codes.
TLDS = frozenset("com org net edu gov mil int info biz io dev app de fr es it pt br uk us ca mx ar cl co eu ch at be nl pl ru cn jp in au".split())
ISSUERS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[68])|35|6(?:011|4[4-9]|5)")
CALLING = re.compile(r"1|7|2(?:0|7|[1-6][0-9])|3(?:[0-469]|5|7|8)|4(?:[013-9]|2)|5(?:[1-8]|0|9)|6(?:[0-6]|7|8|9)|8(?:[1246]|5|8)|9(?:[0-58]|6|7|9)")
# Context: words that speak for each kind, and words that speak for another sort of number.
CUES = {
    EMAIL: "email e-mail mail contact write reply address correo courriel kontakt escreva contato".split(),
    IP: "ip ipv4 ipv6 host server client address login adresse servidor serveur".split(),
    CARD: "card visa mastercard amex credit debit payment cartao cartão tarjeta carte karte kreditkarte kartennummer".split(),
    PHONE: "phone tel tel. telephone telefon telefone teléfono téléphone call mobile cell fax celular ligue whatsapp anruf appelez".split(),
}
AGAINST = "version release build isbn issn doi order invoice serial sku ref token hash key section chapter page pages pp id sum total tracking".split()
WORDS = re.compile(r"[^\W\d_][\w.-]*")
LABELERS = ("shape", "validity", "gazetteer", "context", "border")
FEATURES = 24


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of addresses, leftmost first and apart; not whole where the domain has no dot."""
    last = 0
    for at in AT.finditer(text):
        start = p = at.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, p + 1) if start < p else None
        if found:
            last = found.end()
            yield start, last, True
        elif start < p and p + 1 < len(text) and text[p + 1].isalnum():
            yield start, re.compile(r"[A-Za-z0-9-]*").match(text, p + 1).end(), False


def proposals(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]:
    """(base, others): spans (start, kind, end) that the base patterns and their rules take, and (start, kind, end, failed) of what else may be personal data.

    failed: of a base pattern's form, but against its rule. No other span touches a base span.
    """
    base, others = [], []
    if "@" in text:
        for start, end, whole in emails(text):
            (base.append((start, EMAIL, end)) if whole else others.append((start, EMAIL, end, True)))
    for kind, pattern in ((IP, BASE_IP), (CARD, BASE_CARD), (PHONE, BASE_PHONE)):
        for m in pattern.finditer(text):
            body = m.group()
            if kind == IP:
                good, likely = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in body.split(".")), True
            else:
                digits = re.sub("[^0-9]", "", body)
                likely = 12 <= len(digits) <= 19 if kind == CARD else True
                good = likely and luhn(digits) if kind == CARD else 9 <= len(digits) <= 15
            if good:
                base.append((m.start(), kind, m.end()))
            elif likely:
                others.append((m.start(), kind, m.end(), True))
    for m in SPELT_AT.finditer(text):
        local, domain = SPELT_LOCAL.search(text[max(0, m.start() - 64) : m.start()]), SPELT_DOMAIN.match(text, m.end())
        if local and domain:
            others.append((m.start() - len(local.group()), EMAIL, domain.end(), False))
    for kind, pattern in ((IP, LONG_IP), (CARD, LOOSE_CARD), (PHONE, LOOSE_PHONE)):
        others += [(m.start(), kind, m.end(), False) for m in pattern.finditer(text)]
    base.sort()
    taken = []  # base spans merged, to tell at once what touches one
    for start, _, end in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    free, at = [], 0
    for other in sorted(set(others), key=lambda o: (o[0], o[1], -o[2])):
        while at < len(taken) and taken[at][1] <= other[0]:
            at += 1
        if at == len(taken) or taken[at][0] >= other[2]:
            free.append(other)
    return base, free


def judged(text: str, kind: int, start: int, end: int, base: bool, failed: bool) -> tuple[str, int]:
    """(votes, features): each labeler's vote on a span, y, n or - for none, and the span's features as bits of a number."""
    body = text[start:end]
    digits = re.sub("[^0-9]", "", body)
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    near, next_to = [w.lower().rstrip(".-") for w in WORDS.findall(before)], [w.lower().rstrip(".-") for w in WORDS.findall(after)]
    cue, against = any(w in CUES[kind] for w in near), any(w in AGAINST for w in near[-3:])
    left, right = before[-1:].isalnum() or before[-1:] in ("_", "@"), after[:1].isalnum() or after[:1] in ("_", "@")
    if kind == CARD:
        valid, listed = luhn(digits) and 12 <= len(digits) <= 19, bool(ISSUERS.match(digits))
    elif kind == PHONE:
        valid = 9 <= len(digits) <= 15
        listed = bool(CALLING.match(digits.lstrip("0"))) if body[0] == "+" or digits[:2] == "00" else None
    elif kind == IP:
        valid = base or not failed
        listed = False if "." in body and all(len(x) == 1 for x in body.split(".")) else None  # small parts only: often a version
    else:
        name = re.split(r"[.\s)\]}]+", body)[-1].lower()
        valid, listed = not failed and "-." not in body and ".-" not in body, True if name in TLDS else None
    vote = lambda x: "-" if x is None else "y" if x else "n"
    votes = [True if base else False if failed else None, valid, listed, True if cue else False if against else None, False if left or right else None]
    bits = [
        *(kind == k for k in range(4)), base, failed, valid, listed is True, listed is False, cue, against, left, right, any(w in CUES[kind] for w in next_to), start == 0 or before[-1:] == "\n",
        len(digits) >= 12, len(digits) <= 7, body != digits, "(" in body, body[0] == "+" or digits[:2] == "00", any(c.isalpha() for c in body), bool(before.rstrip()[-1:] in (":", "=")), before.rstrip()[-1:] in ("#", "$", "€"), len(set(digits)) <= 2,
    ]
    return "".join(map(vote, votes)), sum(1 << i for i, x in enumerate(bits) if x)


def reliabilities(patterns: list[tuple[int, bool, str, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(priors by kind, [labeler, truth, vote] probabilities) by expectation-maximisation over (kind, base, votes, count).

    Each span is personal data or not; given that, labelers that vote do so independently, each with its own probabilities of y and n; no vote
    says nothing. Base spans are personal data by definition, which anchors the estimate; priors are of the other spans of a kind. The
    start is the majority of votes; added counts hold a labeler to be better than chance until the data say otherwise.
    """
    kinds, base, counts = np.array([p[0] for p in patterns], int), np.array([p[1] for p in patterns], bool), np.array([p[3] for p in patterns], float)
    votes = as_numbers([p[2] for p in patterns])
    belief = np.clip(((votes == 0).sum(axis=1) - (votes == 1).sum(axis=1)) / len(LABELERS) * 0.5 + 0.5, 0.05, 0.95)
    added = np.array([[2.0, 4.0], [4.0, 2.0]])  # by truth (no, yes) and vote (y, n)
    for _ in range(rounds):
        belief = np.where(base, 1.0, belief)
        weight = np.stack([counts * (1 - belief), counts * belief])
        priors = (np.bincount(kinds, weight[1] * ~base, 4) + 2) / (np.bincount(kinds, counts * ~base, 4) + 4)
        table = np.stack([np.stack([np.bincount(votes[:, n], w, 3)[:2] for w in weight]) + added for n in range(len(LABELERS))])
        table /= table.sum(axis=2, keepdims=True)
        belief = posterior(kinds, votes, priors, table)
    return priors, table


def as_numbers(votes: list[str]) -> np.ndarray:
    """Votes as 0 (y), 1 (n), 2 (none), a column for each labeler."""
    return np.array([["yn-".index(v) for v in one] for one in votes], int).reshape(len(votes), len(LABELERS))


def posterior(kinds: np.ndarray, votes: np.ndarray, priors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The probability that spans of these kinds and votes are personal data."""
    logs = np.log(np.stack([1 - priors[kinds], priors[kinds]]))
    silent = np.ones((2, 1))
    for n in range(len(LABELERS)):
        logs = logs + np.log(np.hstack([table[n], silent])[:, votes[:, n]])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_classifier(features: np.ndarray, belief: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights of the features' bits (the last one is constant) for believed labels, by Newton steps with a ridge."""
    x = np.hstack([(features[:, None] >> np.arange(FEATURES)) & 1, np.ones((len(features), 1))]).astype(float)
    w = np.zeros(FEATURES + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - belief)) + ridge * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


SPAN = "array<struct<kind:int,start:int,end:int>>"
OPEN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,features:long>>"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, spans): every document's base spans and other proposals, in order, with votes and features."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.int64())]))
        for batch in batches:
            out = []
            for raw in batch.column(1):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                base, others = proposals(text)
                found = sorted([(s, k, e, True, False) for s, k, e in base] + [(s, k, e, False, f) for s, k, e, f in others])
                out.append([dict(zip(("kind", "start", "end", "base", "votes", "features"), (k, s, e, b, *judged(text, k, s, e, b, f)))) for s, k, e, b, f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type_of)], ["doc", "spans"])
        give_back()

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("body")).mapInArrow(run, f"doc {kind}, spans {OPEN}")


def learn(found: DataFrame) -> np.ndarray:
    """The span classifier's weights, from all candidates' votes."""
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.base", "s.votes", "s.features")
    patterns = each.groupBy("kind", "base", "votes").count().orderBy("kind", "base", "votes").collect()  # at most 2 * 4 * 3 ** 5 rows
    priors, table = reliabilities([tuple(r) for r in patterns])
    groups = each.groupBy("kind", "base", "votes", "features").count().orderBy(F.xxhash64("kind", "base", "votes", "features"), "features", "votes").limit(TRAIN_GROUPS).collect()
    belief = posterior(np.array([g.kind for g in groups], int), as_numbers([g.votes for g in groups]), priors, table)
    belief = np.where([g.base for g in groups], 1.0, belief)
    return fit_classifier(np.array([g.features for g in groups], np.int64), belief, np.array([g["count"] for g in groups], float))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, base, added) for each row: spans (kind, start, end) in code points, end exclusive, kind a place in KINDS, by start, then kind.

    base: what the base patterns take, leftmost and apart for each kind. added: other proposals (spelt-out addresses, other separators, numbers
    without a country code, matches that fail a rule) to which the final classifier gives at least threshold, leftmost first, the longer one of two that start together, and
    touching neither each other nor a base span.

    Five labelers vote on every proposal of every document, base spans included: its form, the validity of its digits or domain, gazetteers (issuers, calling
    codes, ends of domains), words before it, and its borders. Equal votes are counted by Spark (at most 1,944 patterns); expectation-maximisation over those counts
    estimates how reliable each labeler is and how likely each pattern is personal data. A logistic classifier over features of
    the span and its surroundings learns these likelihoods from at most TRAIN_GROUPS groups of equal spans, and decides on every proposal.

    Whole texts are read, once; proposals are written once, and no row leaves its partition but for the counts. Null and empty texts have no spans. Null and repeated
    ids and repeated rows keep their rows. Other columns are not read. Empty tables give an empty result. Proposals are written and the
    classifier learnt when this is called.
    """
    found = durable(candidates(docs, id_col, text_col))
    weights = learn(found)
    kind = docs.schema[id_col].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            kept = ([], [])
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if s["base"]]
                open_ = [s for s in spans if not s["base"]]
                features = np.array([s["features"] for s in open_], np.int64)
                score = ((features[:, None] >> np.arange(FEATURES)) & 1) @ weights[:-1] + weights[-1]
                likely = [s for s, z in zip(open_, score) if z >= np.log(threshold / (1 - threshold))]
                added, stop = [], 0
                for s in sorted(likely, key=lambda s: (s["start"], -s["end"], s["kind"])):
                    if s["start"] >= stop:
                        added.append(s)
                        stop = s["end"]
                for out, chosen in zip(kept, (base, added)):
                    out.append([{k: s[k] for k in ("kind", "start", "end")} for s in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type_of) for x in kept)], ["doc", "base", "added"])

    return found.mapInArrow(decide, f"doc {kind}, base {SPAN}, added {SPAN}").withColumnRenamed("doc", id_col)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
