"""SimHash near-duplicates by deletion-variant signatures (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, bound_batches, small_enough, sorted_runs, table
from weftgraph.operators.graph import connected_components
from weftgraph.storage import discard, materialize

SEED = 42
#: Fingerprints with one key that are compared in one piece; a key of more is split by finer keys.
GROUP = 2048
#: _BITS[x, b] is bit b of the byte x.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int, bits: int) -> bytes:
    """The majority bits of the hashes of a text's word shingles, most significant byte first.

    A-Z count as a-z, words are parted by ASCII white space, repeats count. Fewer words than a shingle
    are one shingle; no words give zero.
    """
    joined = b" ".join(text.lower().split())
    if not joined:
        return bytes(bits // 8)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    if len(starts) <= shingle:
        return digest(joined, SEED)
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    columns = bits // 8
    each = np.frombuffer(hashes, np.uint8).reshape(-1, columns)
    counts = np.bincount((each + np.arange(columns, dtype=np.int64) * 256).ravel(), minlength=256 * columns).reshape(columns, 256)
    ones = counts @ _BITS
    return ((2 * ones > len(each)) << np.arange(8)).sum(1).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, *, shingle: int = 3, bits: int = 64, text: str = "text") -> DataFrame:
    """(doc_id, w0[, w1], node): fingerprint words of every row as signed longs; node stands for the whole fingerprint."""
    bound_batches(docs.sparkSession)
    names = [f"w{i}" for i in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(x, shingle, bits) for x in as_bytes(batch.column("text")))
            words = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, len(names))
            columns = [words[:, i].astype(np.int64) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), pa.array(_node(columns))], ["doc_id", *names, "node"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{x} long" for x in ["doc_id", *names, "node"]))


def _node(words: list[np.ndarray]) -> np.ndarray:
    if len(words) == 1:
        return words[0]
    # fixed odd constants of the 64-bit finalizer of MurmurHash3
    x = words[0].view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + words[1].view(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _variants(words: list[np.ndarray], start: int, width: int) -> np.ndarray:
    """(rows, width + 1): a segment of the fingerprint with bit v cleared, for each v, and last as it is."""
    segment = words[start // 64].view(np.uint64) >> np.uint64(start % 64)
    if start % 64 + width > 64:
        segment |= words[start // 64 + 1].view(np.uint64) << np.uint64(64 - start % 64)
    segment &= np.uint64((1 << width) - 1)
    clear = np.append(~(np.uint64(1) << np.arange(width, dtype=np.uint64)), ~np.uint64(0))
    return segment[:, None] & clear[None, :]


def _keys(words: list[np.ndarray], segments: int, width: int) -> np.ndarray:
    """Level 0: of each segment, every one-wildcard variant and the exact one, as one long with its place."""
    out = [_variants(words, s * width, width) | (np.uint64(s) << np.uint64(48)) | (np.arange(width + 1, dtype=np.uint64) << np.uint64(40))[None, :] for s in range(segments)]
    return np.concatenate(out, 1)


def _finer(key: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Level 1 and 2, for two segments of 32 bits: variants of a half of the segment the key leaves open, then of its quarters.

    What a key leaves open may differ in three bits, so one of two halves differs in one at most.
    """
    level = (key >> np.uint64(52)).astype(np.int64)
    other = 1 - ((key >> np.uint64(48)) & np.uint64(1)).astype(np.int64)
    out = []
    for half in (0, 1):
        for wide, at in ((16, other * 32 + half * 16), (8, None)):
            rows = level == (0 if wide == 16 else 1)
            if not rows.any():
                out.append(np.zeros((len(key), wide + 1), np.uint64))
                continue
            if at is None:
                done = ((key >> np.uint64(51)) & np.uint64(1)).astype(np.int64)
                at = other * 32 + (1 - done) * 16 + half * 8
            segment = (words[0].view(np.uint64) >> at.astype(np.uint64)) & np.uint64((1 << wide) - 1)
            clear = np.append(~(np.uint64(1) << np.arange(wide, dtype=np.uint64)), ~np.uint64(0))
            body = (segment[:, None] & clear[None, :]) * np.uint64(32) + np.arange(wide + 1, dtype=np.uint64)[None, :]
            mixed = (key[:, None] ^ (body << np.uint64(1)) ^ np.uint64(half)) * np.uint64(0xC4CEB9FE1A85EC53)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
            tag = np.uint64(half << 3 | 1 << 4) if wide == 16 else np.uint64(2 << 4)
            kept = ((key >> np.uint64(48)) & np.uint64(1))[:, None] | tag
            out.append(((mixed >> np.uint64(16)) | (kept << np.uint64(48))) * rows[:, None].astype(np.uint64))
    return np.concatenate(out, 1)


def _links(key: np.ndarray, words: list[np.ndarray], node: np.ndarray, most: int, level0: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the fingerprints of equal key and at most `most` differing bits into the same components as all such pairs would."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(bounds, len(key)))
    small = np.repeat((sizes > 1) & (sizes <= 16), sizes)

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in words)

    def split(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False for pairs that agree in the wildcard's place too: they meet under the exact key."""
        if not level0:
            return np.ones(len(i), bool)
        place = ((key[i] >> np.uint64(40)) & np.uint64(255)).astype(np.int64)
        segment = ((key[i] >> np.uint64(48)) & np.uint64(15)).astype(np.int64)
        width = 64 * len(words) // (2 if len(words) == 1 else 8)
        at = segment * width + np.minimum(place, width - 1)
        diff = np.stack([w[i] ^ w[j] for w in words])[at // 64, np.arange(len(i))]
        return (place == width) | (((diff >> (at % 64).astype(np.uint64)) & np.uint64(1)) == 1)

    rows = np.flatnonzero(small)
    for step in range(1, 16):
        i = rows[rows + step < len(key)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        rows = i
        i = i[apart(i, i + step) <= most]
        i = i[split(i, i + step)]
        edges.append((node[i], node[i + step]))
    for a, n in zip(bounds[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        part = [w[a : a + n] for w in words]
        label = np.arange(n)
        todo = np.ones(n, bool)
        while todo.any():  # spread from the least node through all that it reaches, so that many keys give the same edges
            front = np.array([int(np.argmax(todo))])
            root = front[0]
            todo[root] = False
            while len(front):
                rest = np.flatnonzero(todo)
                reached = np.zeros(len(rest), bool)
                for f in front:
                    reached |= sum(np.bitwise_count(w[rest] ^ w[f]).astype(np.int16) for w in part) <= most
                front = rest[reached]
                label[front] = root
                todo[front] = False
        moved = np.flatnonzero(label != np.arange(n))
        edges.append((node[a + moved], node[a + label[moved]]))
    if not edges:
        return node[:0], node[:0]
    a, b = np.concatenate([x for x, _ in edges]), np.concatenate([x for _, x in edges])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return both[:, 0], both[:, 1]


def links(distinct: DataFrame, *, bits: int = 64, segments: int = 2, most: int = 3, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between nodes of distinct fingerprints, enough for the components of all links.

    Every fingerprint is cut into `segments` segments and indexed under each segment's exact value and
    its one-wildcard variants; fingerprints that meet under a key (one shuffle by key) are compared in
    full. With 64 bits and two segments no link of up to three bits is lost. A key shared by more than `group` fingerprints is dealt
    again by variants of halves and then quarters of its open bits (two segments only), which leaves at most 2,048
    to a key; no pair list of a group is made, only joining edges.
    """
    bound_batches(distinct.sparkSession)
    width, names = bits // segments, [f"w{i}" for i in range(bits // 64)]
    columns = ["key", *names, "node", "over"]
    schema = ", ".join(f"{x} long" for x in columns)
    refined = segments == 2 and bits == 64

    def batch_of(arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in arrays], columns)

    def expand(finer: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    words = [part.column(x).to_numpy().copy() for x in names]
                    node = part.column("node").to_numpy()
                    keys = _finer(part.column("key").to_numpy().view(np.uint64), words) if finer else _keys(words, segments, width)
                    each, flat = keys.shape[1], keys.ravel()
                    kept = flat != 0 if finer else np.ones(len(flat), bool)
                    yield batch_of([flat[kept], *(np.repeat(x, each)[kept] for x in [*words, node]), np.zeros(int(kept.sum()), np.int64)])

        return run

    def compare(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, piece in sorted_runs(batches, "key", group if refined and level < 2 else 1 << 62):
                key = rows.column("key").to_numpy().view(np.uint64)
                words = [rows.column(x).to_numpy().view(np.uint64) for x in names]  # bitwise_count takes signed numbers by their absolute value
                node = rows.column("node").to_numpy()
                if piece:
                    yield batch_of([key, *words, node, np.ones(len(key), np.int64)])
                    continue
                a, b = _links(key, words, node, most, level == 0)
                yield batch_of([a, *([b] * len(names)), b, np.zeros(len(a), np.int64)])

        return run

    found, todo = [], distinct.select(F.lit(0).cast("long").alias("key"), *names, "node", F.lit(0).cast("long").alias("over"))
    for level in range(3):
        dealt = todo.mapInArrow(expand(level > 0), schema).repartition("key").sortWithinPartitions("key", "node")
        out = materialize(dealt.mapInArrow(compare(level), schema), "links")
        found.append(out.where("over = 0").select(F.col("key").alias("a"), F.col("node").alias("b")))
        todo = out.where("over = 1")
        if not refined or level == 2 or todo.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(docs: DataFrame, *, shingle: int = 3, bits: int = 64, segments: int = 2, most: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, w0[, w1], component_id) of every row: documents linked by close fingerprints, directly or through others.

    component_id is the smallest doc_id of the component. Equal fingerprints are merged before the
    search, so thousands of copies cost one. Null or blank texts have fingerprint zero and link like any other;
    rows with a null doc_id get their component's id (null if no other member has an id). Repeated rows come back as often as they stand in `docs`.
    """
    names = [f"w{i}" for i in range(bits // 64)]
    rows = materialize(fingerprints(docs, shingle=shingle, bits=bits, text=text), "fingerprints")
    distinct = rows.groupBy("node", *names).agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(distinct, bits=bits, segments=segments, most=most))
    owner = distinct.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = owner.groupBy("component").agg(F.min("least").alias("component_id"))
    label = owner.join(named, "component").select("node", "component_id")
    return rows.join(label, "node").select("doc_id", *names, "component_id")


# ---- Links verified by the Jaccard similarity of shingle sets (the pipeline's stage) --------------------

#: Bits of one print, its segments and their bits, and the members of a key up to which all its pairs are listed at once.
PRINT, PARTS, WIDTH, LISTED = 128, 5, 24, 64
#: Members of a more crowded key that all others are held against in a round, and rounds before the pairs left are joined.
PIVOTS, ROUNDS = 16, 4
#: Rows of a task's nearest partners and crowded keys that are held before they go out.
KEPT = 1 << 17
#: Shingles of the sets of one block.
BLOCK = 1 << 17
#: Bytes of keyed rows dealt to a task; they are sorted and pass by in pieces, so memory doesn't depend on it.
PARTITION_BYTES = 32 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """(n, 2): the distinct 128-bit digests of a text's word shingles, sorted; words and short texts as in fingerprint()."""
    words = text.lower().split()
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    raw = b"".join([xxhash.xxh3_128_digest(x, SEED) for x in grams])
    each = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
    return each[np.lexsort((each[:, 1], each[:, 0]))]


def _prints(digests: np.ndarray, prints: int) -> np.ndarray:
    """The majority bits of a set's digests, and of each further print's remixed digests, as words of 64 bits."""
    each = [digests, *(_mix(digests ^ np.uint64(0x9E3779B97F4A7C15 * p % 2**64)) for p in range(1, prints))]
    bits = np.unpackbits(np.ascontiguousarray(np.concatenate(each, 1)).view(np.uint8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(digests)).view(np.uint64)


def set_prints(rows: DataFrame, *, shingle: int, prints: int, key: str, text: str = "text") -> DataFrame:
    """(key, node, n, w0, w1, ...): of every row, a digest of its shingle set, the set's size and its prints."""
    bound_batches(rows.sparkSession)
    names = ["node", "n", *(f"w{i}" for i in range(2 * prints))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)), np.int64)
            for i, x in enumerate(as_bytes(batch.column("text"))):
                digests = shingle_set(x, shingle)
                out[i, :2] = np.uint64(xxhash.xxh64_intdigest(digests.tobytes(), SEED)).view(np.int64), len(digests)
                if len(digests):
                    out[i, 2:] = _prints(digests, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, out.T.copy())], [key, *names])

    return rows.select(F.col(key).cast("long"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{x} long" for x in [key, *names]))


def _shingles(rows: DataFrame, shingle: int, text: str) -> DataFrame:
    """(node, shingles): the sets of rows that have a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(d[:, 0] ^ _mix(d[:, 1])).view(np.int64) for d in (shingle_set(x, shingle) for x in as_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.select("node", F.col(text).alias("text")).mapInArrow(run, "node long, shingles array<long>")


def _possible(n: np.ndarray, node: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    return (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (node[i] != node[j])


def _pairs_of(key: np.ndarray, words: list[np.ndarray], node: np.ndarray, n: np.ndarray, label: np.ndarray, most: int, similarity: float, whole: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lesser node, greater node, bits): pairs of equal key (of LISTED rows at most), at most `most` differing bits and sizes that allow `similarity`, without those of one label.

    Where `whole` has the words of all prints, pairs that differ in more than `total` of their bits are left out too.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def split(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False for pairs that agree in the wildcard's place too: they meet under the exact key."""
        place = ((key[i] >> np.uint64(40)) & np.uint64(255)).astype(np.int64)
        at = ((key[i] >> np.uint64(48)) & np.uint64(15)).astype(np.int64) * WIDTH + np.minimum(place, WIDTH - 1)
        diff = np.where(at < 64, words[0][i] ^ words[0][j], words[1][i] ^ words[1][j])
        return (place == WIDTH) | (((diff >> (at % 64).astype(np.uint64)) & np.uint64(1)) == 1)

    rows = np.arange(len(key))
    for step in range(1, LISTED):
        i = rows[rows + step < len(key)]
        rows = i = i[key[i] == key[i + step]]
        if not len(i):
            break
        i = i[(label[i] == 0) | (label[i] != label[i + step])]
        bits = sum(np.bitwise_count(w[i] ^ w[i + step]).astype(np.int16) for w in words)
        i, bits = i[bits <= most], bits[bits <= most]
        fits = _possible(n, node, i, i + step, similarity)
        fits &= split(i, i + step)
        if len(whole):
            fits &= np.bitwise_count(whole[:, i] ^ whole[:, i + step]).astype(np.int16).sum(0) <= total
        out.append((node[i[fits]], node[i[fits] + step], bits[fits]))
    if not out:
        return node[:0], node[:0], node[:0]
    a, b, bits = (np.concatenate(x) for x in zip(*out, strict=True))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), bits.astype(np.int64)], 1), axis=0)
    return both[:, 0], both[:, 1], both[:, 2]


def _partners(node: np.ndarray, partner: np.ndarray, bits: np.ndarray, least: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, partner, bits): each node's nearest partner and, with `least`, its least one."""
    if not len(node):
        return node, partner, bits
    chosen = []
    for order in (np.lexsort((partner, bits, node)), *([np.lexsort((partner, node))] if least else [])):
        chosen.append(order[np.append(True, node[order[1:]] != node[order[:-1]])])
    kept = np.unique(np.concatenate(chosen))
    return node[kept], partner[kept], bits[kept]


def _masks(segment: np.ndarray, node: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, node, places): of each segment of a node, the bits of all its places."""
    order = np.lexsort((node, segment))
    segment, node, places = segment[order], node[order], places[order]
    begin = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (node[1:] != node[:-1]))[: len(order)])
    return segment[begin], node[begin], np.bitwise_or.reduceat(places, begin) if len(begin) else places


class _Best:
    """The rows of _listed() kept while a task's keys pass by, so that a node gives a few rows a task and not a few a key.

    Rows are merged as those of different tasks are later; beyond `most` merged rows they go out early, so memory doesn't grow with the task.
    """

    def __init__(self, most: int):
        self.most, self.held, self.rows = most, {}, 0

    def add(self, kind: int, *rows: np.ndarray) -> Iterator[tuple]:
        self.held.setdefault(kind, []).append(rows)
        self.rows += len(rows[0])
        if self.rows > 2 * self.most:
            self.held = {k: [x] for k, *x in self.merged()}
            self.rows = sum(len(x[0][0]) for x in self.held.values())
            if self.rows > self.most:
                yield from self.drained()

    def merged(self) -> Iterator[tuple]:
        for kind, parts in self.held.items():
            x, y, z = (np.concatenate(c) for c in zip(*parts, strict=True))
            if kind == 2:
                yield kind, *_masks(x, y, z)
            else:
                y, x, z = _partners(y, x, z, least=kind == 0)
                yield kind, x, y, z

    def drained(self) -> Iterator[tuple]:
        yield from self.merged()
        self.held, self.rows = {}, 0


def _listed(rows: DataFrame, most: int, similarity: float, partitions: int, every: bool, total: int) -> DataFrame:
    """(kind, key, node, bits) of rows (key, w0, w1, node, n, label, x0, ...) that share keys; x0 and on are the words of all prints or missing.

    With `every`, whose rows have a block too, (a, b, block_a, block_b) instead: all pairs of different labels from keys of at most LISTED members. Else kind 0: a pair (key, node) from such a key, each node's nearest
    partner in a task and its least, which is the same for many members of a crowd. Keys of over LISTED members, whose rows pass by in pieces, give kind 1, a pair of a row and the nearest of the keys' first PIVOTS rows, and kind 2, (segment of a print, node, bits of the places
    whose keys are crowded), so that the pairs left out can be found, see _crowded_keys().
    """
    columns = ["key", "w0", "w1", "node", "n", "label", *(c for c in rows.columns if c[0] == "x"), *(["block"] if every else [])]
    pair = ["a", "b", "block_a", "block_b"]

    def out(kind: int, key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (np.full(len(key), kind), key, node, bits)], ["kind", "key", "node", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, best = _Pivots(most, similarity), _Best(KEPT)
        for part, piece in sorted_runs(batches, "key", LISTED):
            rows = np.stack([part.column(c).to_numpy() for c in columns])
            if not piece:
                _, inverse, count = np.unique(rows[0], return_inverse=True, return_counts=True)
                big = count[inverse] > LISTED
                key, w0, w1, node, n, label, *whole = rows[: len(columns) - every, ~big]
                words = np.array(whole, np.int64).reshape(len(whole), len(key)).view(np.uint64)
                a, b, bits = _pairs_of(key.view(np.uint64), [w0.view(np.uint64), w1.view(np.uint64)], node, n, label, most, similarity, words, total)
                if every:
                    known, at = np.unique(node, return_index=True)
                    blocks = [rows[-1, ~big][at[np.searchsorted(known, x)]] for x in (a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, *blocks)], pair)
                else:
                    yield from (out(*x) for x in best.add(0, np.append(b, a), np.append(a, b), np.append(bits, bits).astype(np.int64)))
                rows = rows[:, big]
            if rows.shape[1] and not every:
                yield from (out(*x) for x in best.add(2, rows[0] >> 48, rows[3], np.int64(1) << (rows[0] >> 40 & 255)))
                for x in pivots.pairs(rows):
                    yield from (out(*y) for y in best.add(1, *x))
        yield from (out(*x) for x in best.drained())

    # by place and the half of the segment that holds no bit the key clears: so all keys of a segment of a set are in two places, and side by side
    half = WIDTH // 2
    upper = F.shiftright("key", 40).bitwiseAND(255).between(half, WIDTH - 1)
    side = F.when(upper, F.col("key").bitwiseAND((1 << half) - 1)).otherwise(F.shiftright("key", half).bitwiseAND((1 << half) - 1))
    dealt = rows.select(*columns).repartition(partitions, F.shiftright("key", 48), upper, side).sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in (pair if every else ["kind", "key", "node", "bits"])))


class _Pivots:
    """Holds the rows of sorted keys (key, w0, w1, node, n, label), coming in pieces, against their key's first PIVOTS rows."""

    def __init__(self, most: int, similarity: float):
        self.most, self.similarity = most, similarity
        self.key, self.pivots = None, np.zeros((6, 0), np.int64)

    def pairs(self, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(lesser node, greater node, bits) of every row and its nearest pivot of another label, at most `most` bits away."""
        begins = np.flatnonzero(np.append(True, part[0, 1:] != part[0, :-1])) if part.shape[1] else []
        for a, b in zip(begins, [*begins[1:], part.shape[1]], strict=True):
            rows = part[:, a:b]
            if self.key != rows[0, 0]:
                self.key, self.pivots = rows[0, 0], rows[:, :PIVOTS]
            elif self.pivots.shape[1] < PIVOTS:
                self.pivots = np.concatenate([self.pivots, rows[:, : PIVOTS - self.pivots.shape[1]]], 1)
            both = np.concatenate([rows, self.pivots], 1)
            i, j = np.arange(b - a)[:, None], (b - a) + np.arange(self.pivots.shape[1])[None, :]
            other = (both[5][i] != both[5][j]) | (both[5][i] == 0)
            w0, w1 = both[1].view(np.uint64), both[2].view(np.uint64)
            bits = np.bitwise_count(w0[i] ^ w0[j]).astype(np.int16) + np.bitwise_count(w1[i] ^ w1[j])
            bits = np.where(other & _possible(both[4], both[3], i, j, self.similarity), bits, self.most + 1)
            best = bits.argmin(1)
            bits = bits[np.arange(b - a), best]
            near = bits <= self.most
            x, y = rows[3][near], self.pivots[3][best[near]]
            yield np.minimum(x, y), np.maximum(x, y), bits[near].astype(np.int64)


def _to_pivots(rows: DataFrame, most: int, similarity: float, turn: int) -> DataFrame:
    """(a, b, bits): of every row of a key, the nearest of the key's pivots that has another label. The pivots change with `turn`."""
    columns = ["key", "w0", "w1", "node", "n", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = _Pivots(most, similarity)
        for batch in batches:
            for found in pivots.pairs(np.stack([batch.column(c).to_numpy() for c in columns])):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "bits"])

    dealt = rows.select(*columns, F.xxhash64("node", F.lit(turn)).alias("turn")).repartition("key").sortWithinPartitions("key", "turn").drop("turn")
    return dealt.mapInArrow(run, "a long, b long, bits long")


def _left(rows: DataFrame, most: int, similarity: float, total: int) -> DataFrame:
    """(a, b, block_a, block_b): all pairs of a key that may be links and have not one label yet, as a join of the rows outside each key's largest label with all its rows.

    A pair comes once, from the first segment where it meets; where that key isn't crowded, _listed() has given it.
    """
    size = rows.where("label != 0").groupBy("key", "label").count()
    top = size.groupBy("key").agg(F.max(F.struct("count", "label")).alias("top")).select("key", F.col("top.label").alias("top"))
    one = rows.join(top, "key", "left").where("top is null or label != top").select("key", F.col("top").alias("top_"), *(F.col(c).alias(f"{c}_") for c in rows.columns if c != "key"))
    words = [c for c in rows.columns if c[0] == "x"]
    diff = [F.col(c).bitwiseXOR(F.col(f"{c}_")) for c in words]
    whole = sum(F.bit_count(x) for x in diff)
    bits = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_"))) for w in ("w0", "w1"))
    fits = F.least("n", "n_") + 1e-9 >= similarity * F.greatest("n", "n_")
    once = F.coalesce(F.col("label") == F.col("top_"), F.lit(False)) | (F.col("node_") < F.col("node"))
    met = one.join(rows, "key").where((F.col("node") != F.col("node_")) & ((F.col("label") != F.col("label_")) | (F.col("label") == 0)) & once & fits & (bits <= most) & (whole <= total) & _first_meeting(diff, most))
    sides = [F.struct(F.col(f"node{x}").alias("node"), F.col(f"block{x}").alias("block")) for x in ("", "_")]
    a, b = F.least(*sides), F.greatest(*sides)
    return met.select(a["node"].alias("a"), b["node"].alias("b"), a["block"].alias("block_a"), b["block"].alias("block_b"))


def _first_meeting(diff: list[Column], most: int) -> Column:
    """Whether a pair that shares `key` and differs by `diff` differs in the bit that the key clears, if any, and meets in no earlier segment; as `split`."""

    def segment(p: int, s: int) -> Column:
        start = s * WIDTH
        low, high = diff[2 * p], diff[2 * p + 1]
        own = F.shiftright(high, start - 64) if start >= 64 else F.shiftrightunsigned(low, start)
        if start < 64 < start + WIDTH:
            own = own.bitwiseOR(F.shiftleft(high, 64 - start))
        return own.bitwiseAND((1 << WIDTH) - 1)

    at, place = F.shiftright("key", 48), F.shiftright("key", 40).bitwiseAND(255)
    first = F.lit(True)
    for p in range(len(diff) // 2):
        near = (F.bit_count(diff[2 * p]) + F.bit_count(diff[2 * p + 1])) <= most
        for s in range(PARTS):
            alike = F.bit_count(segment(p, s))
            first = first & ~((at > 16 * p + s) & (alike <= 1) & near) & ~((at == 16 * p + s) & (place < WIDTH) & (alike == 0))
    return first


def _common(pairs: pa.Table, sets: pa.Table, similarity: float) -> pa.Table:
    """The pairs (a, b) of sets (node, shingles) of at least this Jaccard similarity."""
    node = sets.column("node").to_numpy()
    each = [x.values.to_numpy() for x in sets.column("shingles")]
    size = np.array([len(x) for x in each])
    ids = np.unique(np.concatenate(each), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    order = np.argsort(node)
    a, b = (order[np.searchsorted(node, pairs.column(c).to_numpy(), sorter=order)] for c in "ab")
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    common, held = np.zeros(len(a), np.int64), np.zeros(len(ids), bool)
    bounds = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(a)], strict=True):
        own = ids[begin[a[lo]] : begin[a[lo]] + size[a[lo]]]
        held[own] = True
        common[lo:hi] = [np.count_nonzero(held[ids[x : x + n]]) for x, n in zip(begin[b[lo:hi]].tolist(), size[b[lo:hi]].tolist(), strict=True)]
        held[own] = False
    kept = common + 1e-9 >= similarity * (size[a] + size[b] - common)
    return pa.table({"a": node[a[kept]], "b": node[b[kept]]})


def _in_blocks(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links among pairs (a, b, block_a, block_b): the sets of two blocks meet in one group, once, however many of their pairs are looked at."""
    dealt = pairs.select("a", "b", F.least("block_a", "block_b").alias("one"), F.greatest("block_a", "block_b").alias("two"))
    wanted = reduce(DataFrame.unionByName, [dealt.select(F.col("one").alias("first"), F.col("two").alias("second"), F.col(x).alias("node")) for x in "ab"]).distinct()

    def check(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return _common(x, y, similarity)

    return dealt.groupBy("one", "two").cogroup(wanted.join(sets, "node").groupBy("first", "second")).applyInArrow(check, "a long, b long")


def _blocks(distinct: DataFrame, met: DataFrame) -> DataFrame:
    """(node, block) of the nodes that met another (node, least): those of one crowd, known by its least members, stand in one block or, if they have over BLOCK shingles, in several."""
    hop = met.select(F.col("node").alias("crowd"), "least")
    crowd = met.select("node", F.least("node", "least").alias("crowd")).join(hop, "crowd", "left").select("node", F.least("crowd", "least").alias("crowd"))
    crowd = materialize(crowd.join(distinct.select("node", "n"), "node"), "crowds")
    many = max(1, (crowd.agg(F.sum("n")).first()[0] or 0) // BLOCK)
    parts = crowd.groupBy("crowd").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    split = F.xxhash64("crowd", F.pmod(F.xxhash64("node"), "parts"))
    return crowd.join(parts, "crowd").select("node", F.when(F.col("parts") > 1, split).otherwise(F.pmod(F.xxhash64("crowd"), F.lit(many))).alias("block"))


def _expanded(distinct: DataFrame, p: int, whole: bool) -> DataFrame:
    """Every node, with its label and, if asked for, the words of all its prints and its block, under all keys of its print p."""
    names = [c for c in distinct.columns if c[0] == "w" and c[1:].isdigit()] if whole else []
    columns = ["key", "w0", "w1", "node", "n", "label", *(f"x{c[1:]}" for c in names), *(["block"] if whole else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                w0, w1, *rest = (x.to_numpy() for x in batch.slice(at, 500).columns)
                keys = (_keys([w0, w1], PARTS, WIDTH) | (np.uint64(p) << np.uint64(52))).view(np.int64)
                each = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *(np.repeat(x, each) for x in (w0, w1, *rest)))], columns)

    return distinct.select(f"w{2 * p}", f"w{2 * p + 1}", "node", "n", "label", *(F.col(c).alias(f"x{c[1:]}") for c in names), *(["block"] if whole else [])).mapInArrow(run, ", ".join(f"{x} long" for x in columns))


def _crowded_keys(held: DataFrame) -> DataFrame:
    """(node, keys) of rows (node, w0, w1, ..., segments), segments being an array of (segment of a print, places): the keys at these places, PARTS * (WIDTH + 1) for each print at most."""
    names = [c for c in held.columns if c[0] == "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [part.column(c).to_numpy() for c in names]
                each = [_keys(words[2 * p : 2 * p + 2], PARTS, WIDTH) | (np.uint64(p) << np.uint64(52)) for p in range(len(words) // 2)]
                keys = np.stack(each, 1).reshape(len(part), -1, PARTS, WIDTH + 1)
                wanted = np.zeros(keys.shape, bool)
                lists = part.column("segments")
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                segment, places = (x.to_numpy() for x in lists.flatten().flatten())
                marks = (places[:, None] >> np.arange(WIDTH + 1) & 1).astype(bool)
                np.logical_or.at(wanted, (row, segment >> 4, segment & 15), marks)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([k[w].view(np.int64) for k, w in zip(keys, wanted, strict=True)], pa.list_(pa.int64()))], ["node", "keys"])

    return held.select("node", *names, "segments").mapInArrow(run, "node long, keys array<long>")


def similar_documents(rows: DataFrame, *, key: str, shingle: int = 5, similarity: float = 0.8, prints: int = 5, most: int = 36, share: float = 0.205, text: str = "text") -> DataFrame:
    """(key, component) of every row: rows joined, directly or through others, by links of at least this Jaccard similarity of shingle sets.

    Rows of equal sets are merged. Candidates are sets of which one of `prints` independent prints of 128 bits differs in at most
    `most` bits, and in at most one of some 24-bit segment (deletion variants, as in links()); every candidate is then checked on the
    sets themselves, so that no component holds a false link. Of the pairs of a key first each set's nearest and least partner are checked, and in keys of over LISTED
    members pairs with a few pivots, round by round, which joins crowds of near copies; all pairs that are still in different components then follow, so none is left out,
    but for those that differ in more than `share` of the bits of all prints: at a similarity of 0.8 that is nearly four standard deviations above the mean.
    """
    spark = rows.sparkSession
    held = materialize(set_prints(rows, shingle=shingle, prints=prints, key=key, text=text), "prints")
    names = [f"w{i}" for i in range(2 * prints)]
    total = int(share * PRINT * prints)
    distinct = materialize(held.where("n > 0").groupBy("node").agg(F.min(key).alias(key), *(F.first(c).alias(c) for c in ("n", *names))), "sets")

    def listed(nodes: DataFrame, every: bool) -> list[DataFrame]:
        """One written table of _listed() for each print."""
        # a set becomes PARTS * (WIDTH + 1) rows of so many bytes, so the partitions are sized for these and not for the input
        width = 56 + (16 * prints + 8) * every
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * PARTS * (WIDTH + 1) * width // PARTITION_BYTES))
        return [materialize(_listed(_expanded(nodes, p, every), most, similarity, partitions, every, total), "pairs") for p in range(prints)]

    passes = listed(distinct.withColumn("label", F.lit(0).cast("long")), False)
    out = reduce(DataFrame.unionByName, passes)
    met = out.where("kind = 0").groupBy("node").agg(F.min_by("key", F.struct("bits", "key")).alias("near"), F.min("key").alias("least"))
    met = materialize(met, "met")
    first = met.select("node", F.explode(F.array_distinct(F.array("near", "least"))).alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    segments = out.where("kind = 2").groupBy("node").agg(F.collect_list(F.struct("key", "bits")).alias("segments"))
    crowded = materialize(_crowded_keys(distinct.join(small_enough(materialize(segments, "crowded"), 640), "node")), "crowded")
    ends = materialize(met.select("node").unionByName(crowded.select("node")).distinct(), "ends")
    owners = materialize(distinct.join(ends, "node", "left_semi").select(F.col(key).alias("__key"), "node"), "ends")
    texts = rows.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(small_enough(owners, 32), "__key")
    sets = materialize(_shingles(texts, shingle, "text"), "shingles")

    tried: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs of nearest ones; pairs of these that were checked before aren't checked again."""
        pairs = pairs.distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "candidates")
        tried.append(pairs)
        one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        kept = F.col("common") + 1e-9 >= similarity * (F.size("sa") + F.size("sb") - F.col("common"))
        return materialize(both.where(kept).select("a", "b"), "verified")

    def all_verified(pairs: DataFrame) -> DataFrame:
        """The links among all pairs that are left (a, b, block_a, block_b)."""
        pairs = materialize(pairs.distinct(), "candidates")
        links_ = materialize(_in_blocks(pairs, sets, similarity), "verified")
        discard(pairs)
        return links_

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("b").agg(F.min_by("a", "bits").alias("a")).select("a", "b")

    edges = verified(first.unionByName(nearest(out.where("kind = 1").select(F.col("key").alias("a"), F.col("node").alias("b"), "bits"))))
    parts = materialize(connected_components(edges), "parts")
    discard(*passes)
    # all pairs of small keys that these links have not joined
    open_nodes = distinct.join(met.select("node"), "node", "left_semi").join(parts.select("node", F.col("component").alias("label")), "node", "left").fillna(0, ["label"])
    blocks = materialize(_blocks(distinct, met), "blocks")
    passes = listed(materialize(open_nodes.join(blocks, "node"), "met"), True)
    edges = edges.unionByName(all_verified(reduce(DataFrame.unionByName, passes)))
    parts = materialize(connected_components(edges), "parts")
    discard(*passes)

    crowded = materialize(crowded.select("node", F.explode("keys").alias("key")), "crowded")

    def mixed() -> DataFrame:
        """Rows of the crowded keys whose members aren't all joined yet."""
        held_keys = materialize(crowded.join(parts.select("node", F.col("component").alias("label")), "node", "left").fillna(0, ["label"]), "mixed")
        open_ = held_keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high or low = 0").select("key")
        met = materialize(held_keys.join(open_, "key", "left_semi"), "mixed")
        discard(held_keys)
        p = F.shiftright("key", 52)
        words = [F.element_at(F.array(*(F.col(f"w{2 * i + j}") for i in range(prints))), (p + 1).cast("int")).alias(f"w{j}") for j in (0, 1)]
        block = F.coalesce("block", F.xxhash64("node")).alias("block")
        return materialize(met.join(distinct.select("node", "n", *names).join(blocks, "node", "left"), "node").select("key", *words, "node", "n", "label", block, *(F.col(c).alias(f"x{c[1:]}") for c in names)), "mixed")

    left = mixed()
    for turn in range(ROUNDS):
        if left.isEmpty():
            break
        new = verified(nearest(_to_pivots(left, most, similarity, turn)))
        if new.isEmpty():
            break
        edges = edges.unionByName(new)
        parts = materialize(connected_components(edges), "parts")
        left = mixed()
    if not left.isEmpty():
        edges = edges.unionByName(all_verified(_left(left, most, similarity, total)))
        parts = materialize(connected_components(edges), "parts")
    discard(sets, *tried)
    return held.join(parts, "node", "left").select(key, F.coalesce("component", "node").alias("component"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
