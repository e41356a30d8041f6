"""Cross-tokenizer alignment: token ends of two tokenizers are merged, linked pairs counted over the corpus and joined back."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.session import durable, give_back, per_process

#: Characters of a chunk of documents and documents of one, and characters of the segments aligned together.
CHUNK_CHARS, CHUNK_ROWS, CALL_CHARS = 3_000_000, 65_536, 100_000
#: Segments that a tokenizer gets as one text.
CALL_SEGMENTS = 128
#: A pair of ids is one number: the first tokenizer's id above these bits, the second one's in them.
SIDE_BITS = 32
COUNTS, OF_CHUNK = ["n_a", "n_b", "n_groups", "n_links"], ["pairs", "seen", "places", "sizes"]


def byte_alphabet() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


#: A segment begins with a space and ends before the next space that follows no white space.
SEGMENT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")


class Numbered(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class TwoTokenizers:
    """A byte-level tokenizer (A, given a leading space) and a piece tokenizer (B, which adds one), with each id's bytes."""

    def __init__(self, spec: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(spec)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        of = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        #: What an id adds to the written form of groups, by id and whether it ends its side of a group.
        marks = [f"{i}{end}" for end in ",|" for i in range(len(self.a_bytes))] + [f"{i}{end}" for end in ",;" for i in range(len(self.b_bytes))]
        self.written = np.array(marks, object)

        rule = json.loads(spec)
        by_level = rule["pre_tokenizer"] or {}
        apart = by_level.get("type") == "ByteLevel" and by_level.get("use_regex") and not by_level["add_prefix_space"] and not rule["normalizer"]
        apart = apart and all(t["special"] for t in rule["added_tokens"]) and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        #: Cuts a space and a text into what both tokenizers encode by itself: A parts words before their space, and no piece of B holds
        #: a space after something else. Where the two files do not promise that, the whole is one segment.
        self.segments = SEGMENT.findall if apart else lambda text: [text]
        self.space = self.b.encode("a ")[len(self.b.encode("a")) :]  # a lone space, which B cannot be given

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both tokenizers' ids of all segments in a row, and the bytes of each that they cover: all, or none where either does not give it back byte for byte.

        Segments in a row are a text that is cut into these again, so many go through the tokenizers in one call; one that ends in white space
        must be a call's last. Where a call does not come back as it was, its segments are encoded one by one.
        """
        calls: list[list[str]] = [[]]
        for segment in segments:
            calls[-1].append(segment)
            if len(calls[-1]) == CALL_SEGMENTS or segment[-1:].isspace():
                calls.append([])
        covered, parts_a, parts_b = [], [], []
        for call, ids_a, ids_b in zip(calls, *self._ids(["".join(c) for c in calls])):
            if self._is(call, ids_a, ids_b):
                covered += [len(x.encode()) for x in call]
                parts_a.append(ids_a)
                parts_b.append(ids_b)
                continue
            for segment, own_a, own_b in zip(call, *self._ids(call)):
                fair = self._is([segment], own_a, own_b)
                covered.append(len(segment.encode()) if fair else 0)
                parts_a.append(own_a if fair else [])
                parts_b.append(own_b if fair else [])
        return *(np.fromiter(chain.from_iterable(x), np.int64) for x in (parts_a, parts_b)), np.array(covered, np.int64)

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        side_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        side_b = self.b.encode([x[1:] for x in texts], out_type=int, num_threads=1)
        return side_a, [self.space if x == " " else ids for x, ids in zip(texts, side_b)]

    def _is(self, call: list[str], ids_a: list[int], ids_b: list[int]) -> bool:
        whole = "".join(call).encode()
        return b"".join(map(self.a_bytes.__getitem__, ids_a)) == whole and b"".join(map(self.b_bytes.__getitem__, ids_b)) == whole


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rising lists of token ends over the same bytes, walked with a pointer in each: (A's token, B's token) of every link, and the shared ends.

    At every end of either list the two tokens that the pointers stand on overlap, and no two tokens overlap in any other
    way: the pointer whose token ends there moves on, both do at a shared end. The pointers at all ends are found at once.
    """
    stops = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two rising runs: merged in one pass
    shared = stops[1:][stops[1:] == stops[:-1]]
    stops = stops[np.concatenate([[True], stops[1:] != stops[:-1]])] if len(stops) else stops
    return np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops), shared


def aligned(kit: TwoTokenizers, segments: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For some segments: (n_a, n_b, n_groups and n_links of each, groups written out of each, links of each, pair of each link, bytes covered of each)."""
    a, b, covered = kit.encode(segments)
    ends_a, ends_b, stops = np.cumsum(kit.a_size[a]), np.cumsum(kit.b_size[b]), np.cumsum(covered)
    i, j, shared = merge_ends(ends_a, ends_b)
    each = lambda ends: np.bincount(np.searchsorted(stops, ends), minlength=len(segments))
    n_a, n_b, n_groups, n_links = each(ends_a), each(ends_b), each(shared), each(np.minimum(ends_a[i], ends_b[j]))
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    # A's tokens of a group come before B's: each stands after all tokens of earlier groups and those of its own side before it
    marks = np.empty(len(a) + len(b), np.int64)
    marks[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + len(kit.a_bytes) * last_a
    marks[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * len(kit.a_bytes) + b + len(kit.b_bytes) * last_b
    written, at = kit.written[marks].tolist(), np.cumsum(np.concatenate([[0], n_a + n_b])).tolist()
    groups = ["".join(written[x:y])[:-1] for x, y in zip(at, at[1:])]
    return np.stack([n_a, n_b, n_groups, n_links], axis=1), groups, n_links, a[i] << SIDE_BITS | b[j], covered


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values that end at ends; running sums may wrap, their differences do not."""
    run = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return run[ends] - run[np.concatenate([[0], ends[:-1]]).astype(np.int64)]


def link_chunks(docs: DataFrame, spec: bytes, model: bytes, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """A row for each document: (doc, n_a, n_b, n_groups, n_links, groups_sha256[, groups], chunk, at, times, pairs, seen, places, sizes).

    Documents lie in chunks. at lists which of the chunk's distinct segments a document holds, times how often. A
    chunk's first document carries its distinct pairs, how often the chunk has each (pairs, seen), and for every segment how many links it has
    and where their pairs stand in pairs (sizes, places); these four are null in the others.
    """
    kit_of = docs.sparkSession.sparkContext.broadcast((spec, model))
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("body"))
    names = ["doc", *COUNTS, "groups_sha256", *["groups"] * with_groups, "chunk", "at", "times", *OF_CHUNK]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = kit_of.value
        kit = per_process(("two tokenizers", hash(own)), lambda: TwoTokenizers(*own))
        task, nth = TaskContext.get().partitionId(), 0
        ids: list[str | None] = []
        held: list[np.ndarray] = []
        whole: list[bool] = []
        number, chars = Numbered(), 0

        def close() -> pd.DataFrame:
            segments = list(number)
            parts, start = [], 0
            while start < len(segments):
                stop, size = start, 0
                while stop < len(segments) and (size < CALL_CHARS or stop == start):
                    size += len(segments[stop])
                    stop += 1
                parts.append(aligned(kit, segments[start:stop]))
                start = stop
            number.clear()
            counts, sizes, links = (np.concatenate([p[n] for p in parts] or [empty]) for n, empty in ((0, np.empty((0, 4), np.int64)), (2, np.empty(0, np.int64)), (3, np.empty(0, np.int64))))
            written, fair = [g for p in parts for g in p[1]], np.concatenate([p[4] for p in parts] or [np.empty(0)]) > 0
            flat = [x if ok and fair[x].all() else x[:0] for x, ok in zip(held, whole)]
            length = np.array([len(x) for x in flat])
            told = [";".join(map(written.__getitem__, x.tolist())) for x in flat]
            used = np.concatenate(flat)
            usage = np.bincount(used, minlength=len(segments))
            owner = np.repeat(np.arange(len(segments)), sizes)
            live = usage[owner] > 0
            pairs, places = np.unique(links[live], return_inverse=True)
            key, times = np.unique(np.repeat(np.arange(len(flat)), length) * max(1, len(segments)) + used, return_counts=True)
            at, cuts = (key % max(1, len(segments))).astype(np.int32), np.searchsorted(key, np.arange(1, len(flat)) * max(1, len(segments)))
            out = pd.DataFrame({"doc": np.array(ids, object)})
            out[COUNTS] = sums(counts[used], np.cumsum(length))
            out["groups_sha256"] = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in told]
            if with_groups:
                out["groups"] = told
            out["chunk"] = task << 32 | nth
            out["at"], out["times"] = (pd.Series(np.split(x, cuts), dtype=object) for x in (at, times.astype(np.int32)))
            seen = np.bincount(places, usage[owner[live]], len(pairs)).astype(np.int64)
            for name, value in zip(OF_CHUNK, (pairs, seen, places.astype(np.int32), np.where(usage > 0, sizes, 0).astype(np.int32))):
                out[name] = pd.Series([value, *[None] * (len(out) - 1)], dtype=object)
            return out[names]

        for frame in frames:
            for doc, raw in zip(frame["doc"], frame["body"]):
                body = (raw or b"").decode("utf-8", "replace")
                found = kit.segments(" " + body) if body else []
                ids.append(doc)
                held.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                whole.append("\ufffd" not in body or body.encode() == raw)
                chars += len(body)
                if chars >= CHUNK_CHARS or len(ids) >= CHUNK_ROWS:
                    yield close()
                    nth, chars = nth + 1, 0
                    ids, held, whole = [], [], []
                    give_back()
            del frame
        if ids:
            yield close()
        number.clear()
        del ids, held, whole
        give_back()

    schema = "doc string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * with_groups
    return rows.mapInPandas(run, f"{schema}, chunk long, at array<int>, times array<int>, pairs array<long>, seen array<long>, places array<int>, sizes array<int>")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, a, b, count, best_of_a, best_of_b): how many links of the corpus each id pair has, and whether that is the most of any pair of its A id, of its B id.

    Chunks have counted their own links already, so a pair comes once from a chunk, however frequent it is. The two tables of
    maxima are no longer than the vocabularies and are broadcast.
    """
    each = chunks.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "seen")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.seen").alias("seen"))
    counted = each.groupBy("pair").agg(F.sum("seen").alias("count"))
    counted = durable(counted.select("pair", F.shiftright("pair", SIDE_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND(2**SIDE_BITS - 1).cast("int").alias("b"), "count"))
    for side in "ab":
        most = counted.groupBy(side).agg(F.max("count").alias("most"))
        counted = counted.join(F.broadcast(most), side).withColumn(f"best_of_{side}", F.col("count") == F.col("most")).drop("most")
    return counted.select("pair", "a", "b", "count", "best_of_a", "best_of_b")


def align(
    docs: DataFrame, byte_level: str | bytes, pieces: str | bytes, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). documents: (id, n_a, n_b, n_groups, n_links, n_best_a, n_best, count_sum, groups_sha256[, groups]); pairs as `pair_counts`.

    Every whole text is encoded by two tokenizers without special tokens: a space and the text by the byte-level one (A, a tokenizers
    file), the text by the piece one (B, a sentencepiece model, which adds the space). Both token lists cover the same bytes. Where tokens of
    both end, groups are cut; tokens that overlap are links (`merge_ends`). Links of the same id pair are counted over
    all documents and joined back: count_sum adds the counts over a document's links, n_best is how many of them have the highest
    count of their B id (n_best_a: of their A id), ties included. groups is written as a1,a2|b1;a3|b2,b3.

    Links never become rows: a task takes a chunk of documents, aligns each distinct segment (a word with its space) once, and numbers the
    distinct pairs; what is counted, shuffled and joined is a row for each chunk and distinct pair. Chunks meet their own documents at last. So neither a frequent pair nor copies of a
    text make a hot key. The documents of chunks are written once; what follows reads what was written.

    Texts null, empty, or not given back byte for byte by either tokenizer have no tokens: zeros and ''. Null and repeated ids
    and repeated rows keep their own rows; ids are of any atomic type and are carried as text. Other columns are not read. Empty tables
    give empty results. Nothing is lazy up to the counts of pairs.
    """
    spec, model = (x if isinstance(x, bytes) else Path(x).read_bytes() for x in (byte_level, pieces))
    chunks = durable(link_chunks(docs, spec, model, id_col, text_col, with_groups))
    pairs = durable(pair_counts(chunks))
    listed = chunks.where(F.col("pairs").isNotNull()).select("chunk", F.posexplode("pairs").alias("place", "pair"))
    known = listed.join(pairs.select("pair", "count", "best_of_a", "best_of_b"), "pair").select("chunk", "place", "count", "best_of_a", "best_of_b")
    kept = ["doc", *COUNTS, "groups_sha256", *["groups"] * with_groups]

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's documents with what their segments' links' pairs add up to."""
        right = right.sort_by("place")
        flat = lambda name: np.concatenate([x.flatten().to_numpy() for x in left.column(name).chunks])
        at, times, places, sizes = (flat(c).astype(np.int64) for c in ("at", "times", "places", "sizes"))
        if right.num_rows <= places.max(initial=-1):
            raise RuntimeError("a chunk and its pairs do not belong together")
        links, ends = np.cumsum(sizes), np.cumsum(left.column("at").combine_chunks().value_lengths().to_numpy())
        columns = [left.column(c) for c in kept]
        for name in ("best_of_a", "best_of_b", "count"):
            value = right.column(name).to_numpy().astype(np.int64)
            of_segment = sums(value[places], links) if len(links) else links
            columns.append(pa.array(sums(of_segment[at] * times, ends)))
        give_back()
        return pa.table(columns, [*kept, "n_best_a", "n_best", "count_sum"])

    texts = chunks.select(F.col("chunk").alias("of"), *kept, "at", "times", "places", "sizes")
    schema = "doc string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * with_groups
    added = texts.groupBy("of").cogroup(known.groupBy("chunk")).applyInArrow(add_up, f"{schema}, n_best_a long, n_best long, count_sum long")
    own = F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col)
    return added.select(own, *COUNTS, "n_best_a", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups), pairs.drop("pair")
