"""Packing of tokenised documents into fixed-length sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.session import durable, give_back, per_process

#: Words whose ids a worker remembers, the bytes of the longest one, documents looked up together, words encoded
#: in one call, and the pieces of a packing group on average.
CACHE_WORDS, CACHE_BYTES, TEXTS, CALL_WORDS, GROUP_PIECES = 1_000_000, 48, 256, 64, 4096
#: A full stop or comma between a letter or digit and white space is a token of its own.
STOP = re.compile(rb"(?<=[0-9A-Za-z])([.,])(?=[ \n])")
#: Parts the words of one call: a control character makes the same ids wherever it stands between spaces.
MARK = "\x01"


class WordEncoder:
    """Ids of a text under a lower-casing tokenizer that drops white space and never joins what it parts.

    Each word between ASCII white space is encoded once and remembered; ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.mark = array("I", self.tokenizer.encode(MARK, add_special_tokens=False).ids)
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """The text's words; case and final stops are evened out where that cannot change an id.

        It could next to combining marks, which might join a small letter but not a capital, and in special tokens.
        """
        if b"\xcc" in text or b"\xcd" in text or b"<|" in text:
            return text.split()
        return STOP.sub(rb" \1", text.lower()).split()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        for at in range(0, len(texts), TEXTS):
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            parts = [self.words(t) for t in texts[at : at + TEXTS]]
            fresh = list(set().union(*parts).difference(self.known))
            self._learn(fresh)
            for words in parts:
                yield b"".join(map(self.known.__getitem__, words))
            for word in fresh:
                if len(word) > CACHE_BYTES:
                    del self.known[word]

    def _learn(self, fresh: list[bytes]) -> None:
        plain = [w.decode() for w in fresh if MARK.encode() not in w]
        calls = [plain[i : i + CALL_WORDS] for i in range(0, len(plain), CALL_WORDS)]
        found = self.tokenizer.encode_batch_fast([f" {MARK} ".join(c) for c in calls], add_special_tokens=False)
        for call, encoding in zip(calls, found):
            ids = array("I", encoding.ids)
            ends = [i for i, x in enumerate(ids) if x == self.mark[0]] if len(self.mark) == 1 else []
            if len(ends) != len(call) - 1:  # the mark is no single id, or also comes from a word
                rows = self.tokenizer.encode_batch_fast(call, add_special_tokens=False)
                self.known.update((w.encode(), array("I", e.ids).tobytes()) for w, e in zip(call, rows))
                continue
            cuts = [-1, *ends, len(ids)]
            self.known.update((w.encode(), ids[a + 1 : b].tobytes()) for w, a, b in zip(call, cuts, cuts[1:]))
        for word in fresh:
            if MARK.encode() in word:
                self.known[word] = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()


def pieces(docs: DataFrame, tokenizer: str | bytes, id_col: str, text_col: str, length: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row for each piece of at most length ids: (doc, start, length, ids_crc32, doc_tokens, salt[, ids])."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer if isinstance(tokenizer, bytes) else Path(tokenizer).read_bytes())
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    end = int(end_id).to_bytes(4, "little")
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "salt"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("word encoder", hash(spec.value)), lambda: WordEncoder(spec.value))
        seen = 0
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            owner, start, size, crc, total, blobs = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                view = memoryview(ids + end)
                tokens = len(view) // 4
                for at in range(0, tokens, length):
                    piece = view[4 * at : 4 * (at + length)]
                    owner.append(i)
                    start.append(at)
                    size.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(tokens)
                    if with_ids:
                        blobs.append(piece.tobytes())
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
            columns.append(pa.array(np.arange(seen, seen + len(owner))))
            seen += len(owner)
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(blobs, pa.binary())] if with_ids else []), names)
        give_back()

    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema)


def first_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size in the given order: the first bin with room.

    A tournament tree over the bins' free room: each inner node holds the most room below it, so the first
    bin that fits is found, and its room brought up to date, in as many steps as the tree has levels.
    """
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out.append((node - leaves, capacity - room[node]))
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return out


def pack(
    docs: DataFrame,
    tokenizer: str | bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Every document's ids, cut into pieces and placed in sequences of at most length ids.

    tokenizer: a tokenizers file (read on the driver and sent to the workers) or its bytes. A document's ids end
    with end_id; from its start, full pieces of length ids are cut, and what is left is a shorter piece. Pieces are dealt to
    random groups of about GROUP_PIECES, and in each group the longest piece first goes to the first
    sequence with room. Returns (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]); offsets
    are gapless from 0 in each sequence, and a sequence's other ids are padding.

    Null and empty texts are the end_id alone. Null and repeated ids and repeated rows keep their own pieces; a
    group is dealt by piece, not by id, so a repeated row cannot crowd one. Ties in length go by id, start, checksum and
    input order. Other columns are not read. An empty table gives an empty result.
    """
    cut = durable(pieces(docs, tokenizer, id_col, text_col, length, end_id, with_ids))
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("doc", "start", "salt", F.lit(seed)), F.lit(groups)))
    kind = cut.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    kept = ["doc", "start", "length", "ids_crc32", "doc_tokens"]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc", "start", "ids_crc32", "salt"], ascending=[False, True, True, True, True], kind="stable")
        placed = np.array(first_fit(group["length"].tolist(), length), np.int64).reshape(-1, 2)
        group["sequence_id"] = group["pack"].to_numpy() * 2**32 + placed[:, 0]
        group["offset"] = placed[:, 1]
        return group[[*kept, "sequence_id", "offset", *["ids"] * with_ids]]

    packed = dealt.groupBy("pack").applyInPandas(fit, schema)
    return packed.withColumnRenamed("doc", id_col)


def sequences(packed: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed pieces as whole sequences: (sequence_id, ids of exactly length, used), from pack(with_ids=True)."""

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.full(length, pad_id, np.int64)
        for at, piece in zip(group["offset"], group["ids"]):
            part = np.frombuffer(piece, "<u4")
            ids[at : at + len(part)] = part
        return pd.DataFrame({"sequence_id": [group["sequence_id"].iloc[0]], "ids": [ids], "used": [int(group["length"].sum())]})

    return packed.groupBy("sequence_id").applyInPandas(lay, "sequence_id long, ids array<long>, used long")
