"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.llm.columns import carried, laid_out
from campovia.llm.components import connected_components
from campovia.session import durable, give_back

WORD = 64
#: Shingle hashes whose bits are counted at once, and fingerprints compared with a bucket at once.
HASH_BLOCK, PROBE_BLOCK = 16_384, 256
#: Buckets up to this size are compared in shifted vectors; larger ones are cut further and what is dense is searched breadth first.
SMALL_BUCKET = 64
#: Comparisons made at once in a search, and links that a task holds before it joins them.
AT_ONCE, LINKS_HELD = 4_000_000, 100_000
#: Multipliers of the 64-bit mixer that makes further hashes of a shingle from its first one.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of shingles, 0 being the given one."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(MIX[0] * k % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, WORD).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def simhash(text: bytes, width: int, seed: int, words: int = 1) -> np.ndarray:
    """The SimHash of a UTF-8 text as 64-bit words: A-Z lower-cased, shingles of width words between ASCII white space."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(words, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    reach = min(width, len(tokens))
    total = len(tokens) - reach + 1
    first, last = (ends - sizes)[:total].tolist(), (ends[reach - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((words, WORD), np.int64)
    for at in range(0, total, HASH_BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + HASH_BLOCK], last[at : at + HASH_BLOCK])], np.uint64)
        for k in range(words):
            ones[k] += _ones(_mixed(hashes, k))
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.uint64)[:, 0]


def word_columns(words: int) -> list[str]:
    """The names of a fingerprint's words."""
    return [f"w{k}" for k in range(words)]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int = 42, words: int = 1) -> DataFrame:
    """(doc, print, w0, w1, ...) for each row: print is a hash of the text; a null or blank text has all words 0."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("body"))
    names = ["doc", "print", *word_columns(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.array([simhash(t.as_py() or b"", width, seed, words) for t in texts], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(words))], names)
        give_back()

    kinds = ", ".join(f"{c} long" for c in word_columns(words))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, print long, {kinds}")


def segments(max_bits: int, words: int, each: int | None = None) -> list[tuple[int, int, int]]:
    """(word, shift, width) of equal segments, each of them in a word: given, or the fewest of which one must differ by at most one bit."""
    each = each or -(-(max_bits // 2 + 1) // words)
    edges = [WORD * i // each for i in range(each + 1)]
    return [(k, a, b - a) for k in range(words) for a, b in zip(edges, edges[1:])]


def signatures(fps: DataFrame, max_bits: int, words: int, each: int | None = None) -> DataFrame:
    """(slot, part, words): each segment with each of its bits deleted, at that bit's slot, and whole, at a slot after all bits'."""
    keys = []
    for i, (k, shift, width) in enumerate(segments(max_bits, words, each)):
        part = F.shiftrightunsigned(f"w{k}", shift).bitwiseAND(F.lit((1 << width) - 1 if width < WORD else -1))
        keys.append(F.struct(F.lit(WORD * words + i).alias("slot"), part.alias("part")))
        keys += [F.struct(F.lit(WORD * k + shift + b).alias("slot"), part.bitwiseAND(F.lit(~(1 << b) if b < WORD - 1 else 2 ** (WORD - 1) - 1)).alias("part")) for b in range(width)]
    names = word_columns(words)
    return fps.select(*names, F.explode(F.array(*keys)).alias("key")).select("key.slot", "key.part", *names)


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words lie in the first axis."""
    return np.bitwise_count(left ^ right).sum(axis=0, dtype=np.int16) if len(left) > 1 else np.bitwise_count(left[0] ^ right[0])


def spanning_links(values: np.ndarray, side: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indexes) that connect the members of a bucket just as all its close pairs do.

    values: words x members. With side, only pairs of members on different sides count. Breadth first
    over members not yet reached: each is compared with the reached ones once, so a dense bucket
    costs little more than its size, and at most one link a member comes out.
    """
    out_a, out_b, lone, sifted = [], [], 0, False
    rest = np.arange(values.shape[1])

    def close(probe: np.ndarray, others: np.ndarray) -> np.ndarray:
        near = _apart(values[:, probe, None], values[:, None, others]) <= max_bits
        return near if side is None else near & (side[probe, None] != side[None, others])

    while len(rest) > 1:
        front, rest, alone = rest[:1], rest[1:], True
        while len(front) and len(rest):
            size = max(1, min(PROBE_BLOCK, AT_ONCE // len(rest)))
            probe, front = front[:size], front[size:]
            near = close(probe, rest)
            hit = near.any(axis=0)
            if hit.any():
                alone = False
                out_a.append(probe[near[:, hit].argmax(axis=0)])
                out_b.append(rest[hit])
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
        lone = lone + 1 if alone else 0
        if lone >= 8 and not sifted:  # mostly strangers: go on with those that have a close one
            size = max(1, min(PROBE_BLOCK, AT_ONCE // max(1, len(rest))))
            counts = [close(rest[at : at + size], rest).sum(axis=1) for at in range(0, len(rest), size)]
            if counts:
                rest = rest[np.concatenate(counts) > (side is None)]
            sifted = True
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _in_runs(new: np.ndarray, sizes: np.ndarray, values: np.ndarray, sides: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indexes) of the runs that begin at new, of up to SMALL_BUCKET members: pairs of different sides, where there are sides (-1: any)."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    size_of = np.repeat(sizes, sizes)
    index_of = np.arange(len(size_of)) - np.repeat(new, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL_BUCKET))
    for step in range(1, SMALL_BUCKET):
        small = small[index_of[small] + step < size_of[small]]
        if not len(small):
            break
        i = small if sides is None else small[(sides[small] < 0) | (sides[small] != sides[small + step])]
        ok = _apart(values[:, i], values[:, i + step]) <= max_bits
        found_a.append(i[ok])
        found_b.append(i[ok] + step)
    return np.concatenate(found_a), np.concatenate(found_b)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their sizes."""
    other = np.zeros(len(keys[0]), bool)
    for key in keys:
        other[1:] |= key[1:] != key[:-1]
    new = np.flatnonzero(np.concatenate([[True], other[1:]])) if len(other) else np.empty(0, np.int64)
    return new, np.diff(np.concatenate([new, [len(other)]]))


def _large_links(values: np.ndarray, side: np.ndarray | None, max_bits: int, shift: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large bucket, whose members share a segment of width bits at shift.

    Fingerprints of one word are cut again: of max_bits + 1 parts of the other bits two close ones have one in common, so only members
    that share a part are compared, in runs as small buckets are. What still is a large run is dense, and searched breadth first, as
    are buckets of which the parts would be too short to tell strangers apart.
    """
    rest = WORD - width
    if len(values) > 1 or rest // (max_bits + 1) < 5:
        return spanning_links(values, side, max_bits)
    own = values[0]
    turn = np.uint64((shift + width) % WORD)
    turned = (own >> turn) | (own << (np.uint64(WORD) - turn)) if turn else own
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    edges = [rest * i // (max_bits + 1) for i in range(max_bits + 2)]
    for low, high in zip(edges, edges[1:]):
        part = (turned >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(part, kind="stable")
        new, sizes = _runs(part[order])
        a, b = _in_runs(new, sizes, values[:, order], None if side is None else side[order].astype(np.int8), max_bits)
        found_a.append(order[a])
        found_b.append(order[b])
        for k in np.flatnonzero(sizes > SMALL_BUCKET):
            run = order[new[k] : new[k] + sizes[k]]
            a, b = spanning_links(values[:, run], None if side is None else side[run], max_bits)
            found_a.append(run[a])
            found_b.append(run[b])
    return np.concatenate(found_a), np.concatenate(found_b)


def _bucket_links(slots: np.ndarray, parts: np.ndarray, values: np.ndarray, max_bits: int, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indexes) of whole buckets, given in order of (slot, part), of fingerprints with the segments cuts."""
    words, rows = values.shape
    new, sizes = _runs(slots, parts)
    exact = slots >= WORD * words
    word_of = np.where(exact, 0, slots // WORD)
    bit = (values[word_of, np.arange(rows)] >> (slots % WORD).astype(np.uint64)) & np.uint64(1)  # the deleted bit; of no use at whole segments
    a, b = _in_runs(new, sizes, values, np.where(exact, -1, bit.astype(np.int64)), max_bits)
    found_a, found_b = [a], [b]
    for k in np.flatnonzero(sizes > SMALL_BUCKET):
        own, slot = slice(new[k], new[k] + sizes[k]), int(slots[new[k]])
        _, shift, width = cuts[slot - WORD * words] if exact[new[k]] else next(c for c in cuts if c[0] == slot // WORD and c[1] <= slot % WORD < c[1] + c[2])
        a, b = _large_links(values[:, own], None if exact[new[k]] else bit[own], max_bits, shift, width)
        found_a.append(a + new[k])
        found_b.append(b + new[k])
    return np.concatenate(found_a), np.concatenate(found_b)


def rooted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links given as rows of fingerprints, as links of each fingerprint to the smallest one it is connected with.

    Buckets that hold the same dense group mostly name the same smallest member, so few different links are left.
    """
    both, at = np.unique(np.concatenate([left, right]), axis=0, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(both))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(both)))
    return both[own], both[root[own]]


def close_pairs(fps: DataFrame, max_bits: int, words: int, each: int | None = None) -> DataFrame:
    """(a, b) links, as hexadecimal fingerprints, that connect all distinct fingerprints joined by pairs at most max_bits bits apart.

    With a given number of segments in each word, only those pairs of which one segment differs by at most one bit.
    """
    index, cuts = signatures(fps, max_bits, words, each), segments(max_bits, words, each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the bucket that the next batch may continue

        none = np.empty((0, words), np.uint64)
        found = [(none, none)]  # links of the buckets so far, each node's to the smallest it is connected with

        def links(cols: list[tuple[np.ndarray, ...]]) -> None:
            slots, parts = (np.concatenate([x[i] for x in cols]) for i in (0, 1))
            values = np.concatenate([x[2] for x in cols], axis=1)
            a, b = _bucket_links(slots, parts, values, max_bits, cuts)
            found.append((values[:, a].T, values[:, b].T))
            if sum(len(x) for x, _ in found[1:]) > max(LINKS_HELD, len(found[0][0])):
                found[:] = [rooted(*(np.concatenate(x) for x in zip(*found)))]

        for batch in batches:
            if not batch.num_rows:
                continue
            slots, parts, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + words))
            values = np.stack(rest).view(np.uint64)
            cut = len(slots) - int(((slots == slots[-1]) & (parts == parts[-1])).sum())
            if cut:
                links([*held, (slots[:cut], parts[:cut], values[:, :cut])])
                held = []
            elif held and (held[-1][0][-1], held[-1][1][-1]) != (slots[0], parts[0]):
                links(held)
                held = []
            held.append((slots[cut:], parts[cut:], values[:, cut:]))
        if held:
            links(held)
        nodes, roots = rooted(*(np.concatenate(x) for x in zip(*found)))
        for at in range(0, len(nodes), 10_000):
            ends = [[row.astype(">u8").tobytes().hex() for row in side[at : at + 10_000]] for side in (nodes, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ends], ["a", "b"])
        held.clear()
        found.clear()
        give_back()

    return index.repartition("slot", "part").sortWithinPartitions("slot", "part").mapInArrow(run, "a string, b string").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = 19, words: int = 2, seed: int = 42
) -> DataFrame:
    """(id, fingerprint, component_id): each row's id with the smallest id of its near-duplicate component.

    Two documents are linked when their SimHash fingerprints of 64 * words bits differ by at most max_bits
    bits; components are the transitive closure. The default, 19 of 128 bits over five-word shingles, is
    an estimated similarity of 0.8 or more: cos(pi * 19 / 128) = 0.893 is the cosine of equally large shingle sets of
    which 0.807 of the union is shared. Copies share a fingerprint and are compared once. Each fingerprint is cut into so
    few segments that in one of them two linked ones differ by one bit at most; each segment is indexed whole and
    with each of its bits deleted, equal signatures meet, and only pairs verified over all bits become links.
    No pair within the distance is missed.

    Null and blank texts have a fingerprint of zeros and are linked like any others. Rows with a null id keep their
    row; their component is the smallest id of the others in it, or null. Repeated ids and rows are kept.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    grouped = _grouped(docs, id_col, text_col, width, max_bits, words, seed)
    return grouped.select(F.col("doc").alias(id_col), "fingerprint", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int, words: int, seed: int) -> DataFrame:
    """(doc, print, fingerprint, component_id), one row for each row of docs."""
    names = word_columns(words)
    marked = durable(fingerprints(docs, id_col, text_col, width, seed, words))
    fingerprint = F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in names)).alias("fingerprint")
    least = durable(marked.groupBy(*names).agg(F.min("doc").alias("first")).withColumn("fingerprint", fingerprint))
    roots = connected_components(close_pairs(least.select(*names), max_bits, words), "a", "b").withColumnRenamed("node", "fingerprint")
    placed = least.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    component = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(component, "root").select("fingerprint", "component_id")
    return marked.select("doc", "print", fingerprint).join(by_fp, "fingerprint", "left")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs, all columns, with one document left of each near-duplicate component: that of the smallest id.

    Documents are linked where the sets of their shingles have a Jaccard similarity of at least the given one, told exactly
    (`shingle_links.similar_groups`). Of texts that share the smallest id the one of the smallest hash stays, and rows equal in id and text
    leave one row. Null and blank texts are similar to each other alone. Components without any id leave a row for each different text, for
    nothing tells which to keep. Columns may have any names. An empty table gives an empty result. The links are made when this is called.
    """
    from campovia.llm.shingle_links import similar_groups

    groups = similar_groups(docs, id_col, text_col, width, similarity, seed)
    known = groups.where("doc = component_id").groupBy("component_id").agg(F.min("print").alias("text")).select(F.col("component_id").alias("id"), "text")
    unknown = groups.where("component_id IS NULL").select(F.col("doc").alias("id"), F.col("print").alias("text")).distinct()
    own = docs.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("print"), carried(docs.columns).alias("row"))
    first = own.join(known.union(unknown), F.col("own").eqNullSafe(F.col("id")) & (F.col("print") == F.col("text")), "left_semi")
    return first.dropDuplicates(["own", "print"]).select(*laid_out("row", docs.columns).values())
