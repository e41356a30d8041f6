"""Byte-level BPE encoding and decoding by a global shuffle of distinct pre-tokens."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campovia.session import bucketed, give_back, per_process

#: Text and rows after which a chunk of documents closes, and list entries that one part of the word shuffle takes on average.
CHUNK_CHARS, CHUNK_ROWS, PART_WORDS = 8_000_000, 100_000, 500_000
#: Values of the 32-bit hash by which words are dealt.
HASHES = 2**32


class Numbered(dict):
    """Word -> number, numbers given in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as four byte planes, which compress better than the numbers."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers_of(data: bytes) -> np.ndarray:
    """The numbers of byte planes."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def squeezed(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueezed(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def packed(sizes: np.ndarray, body: bytes) -> bytes:
    """Items of the given sizes, which lie one behind the other in body, as one compressed blob."""
    return squeezed(len(sizes).to_bytes(4, "little") + planes(sizes) + body, 3)


def unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    """The sizes and the body again."""
    data = unsqueezed(blob)
    edge = 4 + 4 * int.from_bytes(data[:4], "little")
    return numbers_of(data[4:edge]).astype(np.int64), data[edge:]


def items(blob: bytes) -> list[bytes]:
    """The items of a blob."""
    sizes, body = unpacked(blob)
    ends = np.cumsum(sizes).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def positions(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Pre-tokens with positions, as chunks of documents: (chunk, ids, sizes, places, ranks, count, words).

    sizes has the pre-tokens of each document, places for each of them, document by document and in order of position, the rank by
    frequency of its word among the chunk's distinct words. Those are listed in order of their hash in words; ranks are theirs.
    chunk is the task's number and the chunk's in it: no two chunks of a written table share a name.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches = regex.compile(pattern).findall
        task, nth = TaskContext.get().partitionId(), 0
        owners: list[pa.Array] = []
        sizes: list[int] = []
        places: list[np.ndarray] = []
        chars, words = 0, Numbered()

        def close() -> pa.RecordBatch:
            flat = np.concatenate(places) if places else np.empty(0, np.uint32)
            rank = np.empty(len(words), np.uint32)
            rank[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.uint32)
            listed = [w.encode() for w in words]
            order = np.argsort(np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed)), kind="stable")
            lengths = np.fromiter((len(listed[i]) for i in order), np.int64, len(order))
            ids = pa.concat_arrays(owners)
            columns = [
                pa.array([task << 32 | nth]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([squeezed(planes(rank[flat]))], pa.binary()), pa.array([squeezed(planes(rank[order]))], pa.binary()),
                pa.array([len(words)], pa.int64()), pa.array([packed(lengths, b"".join(listed[i] for i in order))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "places", "ranks", "count", "words"])

        for batch in batches:
            since = 0
            for i, text in enumerate(batch.column(1)):
                body = text.as_py() or ""
                found = matches(body)
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                sizes.append(len(found))
                chars += len(body)
                if chars >= CHUNK_CHARS or len(sizes) >= CHUNK_ROWS:
                    owners.append(batch.column(0).slice(since, i + 1 - since))
                    yield close()
                    nth, since, chars = nth + 1, i + 1, 0
                    owners, sizes, places, words = [], [], [], Numbered()
                    give_back()
            owners.append(batch.column(0).slice(since))
        if sizes:
            yield close()
        del owners, sizes, places, words
        give_back()

    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, sizes array<int>, places binary, ranks binary, count long, words binary")


def dealt(chunks: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, words): each chunk's list cut into the parts of the hash's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes, body = unpacked(blob)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                hashes = np.fromiter((zlib.crc32(body[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())), np.int64, len(sizes))
                part_of = hashes * parts // HASHES
                edges = np.flatnonzero(np.diff(part_of, prepend=-1, append=parts))
                cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                lists = [packed(sizes[a:b], body[ends[a] : ends[b]]) for a, b in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(cuts), pa.int64()), pa.array(part_of[edges[:-1]].astype(np.int32)), pa.array(lists, pa.binary())], ["chunk", "part", "words"]
                )
        give_back()

    return chunks.select("chunk", "words").mapInArrow(run, "chunk long, part int, words binary")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file's tokens and their ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, packed) for each row: the whole text's token ids as an array, and as little-endian unsigned 32-bit bytes.

    Every match of pattern is a pre-token with its position in its document. The relation of positions is written once, in
    chunks of documents that name each of their distinct pre-tokens once (`positions`), in buckets by chunk. The distinct pre-tokens of
    all chunks meet in one shuffle by ranges of a hash, in as many parts as there are words for, and there each distinct one is
    encoded once, by itself and without special tokens; its ids go back to the chunks that hold it, which meet the positions where these
    lie, and documents are put together by position. A word comes at most once from a chunk, so no word makes a hot
    partition; copies of a text are chunks of their own. Everything after the write reads what was written: tasks can be run
    again at any time. ranks and pattern are those of a byte-level vocabulary, bounded by its size; they are sent to
    the workers.

    Null and empty texts have no ids. Null and repeated ids and repeated rows keep their rows. Other columns are not
    read. An empty table gives an empty result. The written buckets are as many as the session's shuffle partitions. The plan is
    not lazy: the positions are written, and their words counted, when this is called.
    """
    spark = docs.sparkSession
    rules = spark.sparkContext.broadcast((ranks, pattern))
    chunks = bucketed(positions(docs, id_col, text_col, pattern), "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    listed = chunks.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-listed // PART_WORDS))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own_ranks, own_pattern = rules.value
        make = lambda: tiktoken.Encoding("own", pat_str=own_pattern, mergeable_ranks=own_ranks, special_tokens={})
        ids_of = per_process(("byte bpe", own_pattern, len(own_ranks), hash(frozenset(own_ranks.items()))), make).encode_ordinary
        known: dict[bytes, bytes] = {}  # of one part: the rows come sorted by part
        last = None
        for batch in batches:
            out = []
            for part, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if part != last:
                    known.clear()
                    last = part
                words = items(blob)
                known.update((w, np.array(ids_of(w.decode()), "<u4").tobytes()) for w in words if w not in known)
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                out.append(packed(sizes, planes(np.frombuffer(b"".join(found), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["chunk", "part", "found"])
        known.clear()
        give_back()

    lists = dealt(chunks, parts).repartition(parts, "part").sortWithinPartitions("part")
    encoded = lists.mapInArrow(encode_words, "chunk long, part int, found binary")

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's documents: its words' ids, in order of parts as the chunk lists the words, laid where the words stand."""
        found = [unpacked(blob) for blob in right.sort_by("part").column("found").to_pylist()]
        counts = np.concatenate([np.empty(0, np.int64), *(sizes for sizes, _ in found)])
        ids = np.concatenate([np.empty(0, np.uint32), *(numbers_of(body) for _, body in found)])
        chunk = left.to_pylist()[0] if left.num_rows == 1 else None
        if chunk is None or len(counts) != chunk["count"]:
            raise RuntimeError("a chunk and its words do not belong together")
        rank = numbers_of(unsqueezed(chunk["ranks"]))
        starts, lengths = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        starts[rank], lengths[rank] = np.cumsum(counts) - counts, counts
        places = numbers_of(unsqueezed(chunk["places"]))
        length = lengths[places]
        ends = np.concatenate([[0], np.cumsum(length)])
        laid = np.repeat(starts[places] - ends[:-1], length)
        laid += np.arange(ends[-1])
        out = ids[laid]
        del found, places, length, laid
        edges = ends[np.concatenate([[0], np.cumsum(np.array(chunk["sizes"], np.int64))])].astype(np.int32)
        raw = pa.py_buffer(out)
        columns = [
            pa.concat_arrays([x.flatten() for x in left.column("ids").chunks]),
            pa.ListArray.from_arrays(pa.array(edges), pa.Array.from_buffers(pa.int32(), len(out), [None, raw])),
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64) * 4), raw]).cast(pa.binary()),
        ]
        give_back()
        return pa.Table.from_arrays(columns, ["doc", "ids", "packed"])

    texts = chunks.select("chunk", "ids", "sizes", "places", "ranks", "count")
    whole = texts.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(put_together, f"doc {kind}, ids array<int>, packed binary")
    return whole.withColumnRenamed("doc", id_col)


def token_bytes(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The token-byte table: (token, hex) for every id up to the last, hex null where the vocabulary has none."""
    of = {rank: token.hex() for token, rank in ranks.items()}
    return spark.createDataFrame([(i, of.get(i)) for i in range(max(of, default=0) + 1)], "token int, hex string")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """encoded with a column data more: the bytes that the ids stand for.

    Every row is joined with the token-byte table. That is no larger than the vocabulary and is broadcast whole, as one array in
    order of ids, so that no id of a text becomes a row of a shuffle. Null ids give null bytes, no ids
    empty bytes; an id outside the vocabulary ends the job with an error. All other columns stay; none may be called data.
    """
    if "data" in {c.lower() for c in encoded.columns}:
        raise ValueError("a column is called data already")
    listed = F.array_sort(F.collect_list(F.struct("token", "hex")))
    table = token_bytes(encoded.sparkSession, ranks).agg(F.transform(listed, lambda t: t["hex"]).alias("tokens"))
    outside = F.raise_error(F.lit("an id is not in the vocabulary")).cast("string")
    rows = encoded.select(F.struct(*(encoded[c] for c in encoded.columns)).alias("row"), F.col(ids_col).alias("ids"))
    joined = rows.join(F.broadcast(table), F.lit(True), "left")
    hexed = F.array_join(F.transform("ids", lambda i: F.coalesce(F.get("tokens", i), outside)), "")
    return joined.select("row", F.unhex(hexed).alias("data")).select("row.*", "data")
