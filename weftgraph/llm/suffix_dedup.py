"""Exact repeats of long byte strings by merged Burrows-Wheeler transforms (operator 7).

A string of LENGTH bytes that occurs twice holds the same anchor in both places: the 32-byte substring
of least hash in it. So every window of LENGTH bytes belongs to the anchor chosen in it, windows of
different anchors' texts never match, and the work falls into independent groups, one for each anchor
text. The anchors only deal out the work. Every distinct stretch of windows whose anchor stands in
another place too goes into a shard transform, together with its second place, and the merge of the
shards decides which windows repeat. A stretch's third and later places take the verdict of the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, bound_batches, sorted_runs, table, text_buffer
from weftgraph.storage import materialize

LENGTH = 100
ANCHOR = 32
#: Bytes of stretches that one merge takes, and of one of its shards.
MERGE_BYTES = 128 << 10
SHARD_BYTES = 16 << 10
#: Rounds of a merge at most; the words of a round are named by doubling if they don't fit a number.
ROUNDS = 4
#: Bytes whose anchors are chosen at a time.
SKETCH_BYTES = 256 << 10
#: A group of more distinct stretches than this is dealt out again by a longer text around the anchor, and then window by window.
CROWDED = 8192
#: Windows of a stretch that stay together when it is dealt out by a longer text.
RANGE = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed odd multiplier, 2^64 over the golden ratio


# ---- Anchors -----------------------------------------------------------------------------------


def _anchor_hashes(buffer: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ANCHOR bytes from every place on; equal bytes have equal hashes."""
    width, h = 1, buffer.astype(np.uint64) + np.uint64(1)
    while width < ANCHOR:  # join two halves of `width` bytes
        tail = h[width:] * (_ODD + np.uint64(2 * width))
        h = (h[: len(tail)] ^ (h[: len(tail)] >> np.uint64(29))) * _ODD + (tail ^ (tail >> np.uint64(32)))
        width *= 2
    return h ^ (h >> np.uint64(31))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, the place of the leftmost least of the `width` values from there on."""
    low = h.copy()
    at = np.arange(len(h), dtype=np.int32)
    done = 1
    while done < width:
        step = min(done, width - done)
        right, right_at = low[step:], at[step:]
        low, at = low[: len(right)], at[: len(right)]
        take = right < low
        low = np.where(take, right, low)
        at = np.where(take, right_at, at)
        done += step
    return at


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _stretches(buffer: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, windows, anchor hash, digest of all its bytes): every text's windows, cut into runs that chose the same anchor.

    Goes through the bytes piece by piece; a run that a piece's end cuts is two.
    """
    begins, ends = offsets[:-1], offsets[1:]
    long = ends - begins >= length
    edges = np.stack([begins[long], ends[long] - length + 1], 1).ravel()  # where windows begin and no longer begin
    for piece in range(0, len(buffer) - length + 1, SKETCH_BYTES):
        part = buffer[piece : piece + SKETCH_BYTES + length - 1]
        h = _anchor_hashes(part)
        chosen = _least(h, length - ANCHOR + 1)  # window p chose the anchor at chosen[p]
        n = len(chosen)
        inside = np.searchsorted(edges, piece, "right") % 2 == 1
        cut = np.append(True, chosen[1:] != chosen[:-1])
        here = edges[(edges > piece) & (edges < piece + n)] - piece
        cut[here] = True
        begin = np.flatnonzero(cut)
        windows = np.diff(np.append(begin, n))
        ok = (np.searchsorted(here, begin, "right") + inside) % 2 == 1
        begin, windows = begin[ok], windows[ok]
        up, down = _powers(SKETCH_BYTES + length)
        total = np.append(np.uint64(0), np.cumsum(h * up[: len(h)]))
        digest = (total[begin + windows + length - ANCHOR] - total[begin]) * down[begin] + windows.astype(np.uint64) * _ODD
        digest ^= digest >> np.uint64(32)
        text = np.searchsorted(offsets, begin + piece, "right") - 1
        yield text, begin + piece - offsets[text], windows, h[chosen[begin]].view(np.int64), digest.view(np.int64)


# ---- Transforms and their merge ------------------------------------------------------------------


def _packed(text: np.ndarray, first: int, step: int, bits: int) -> np.ndarray:
    """The `step` symbols of `bits` bits from `first` places ahead on, of every place of a shard read in a circle, as one number in their order."""
    out = np.zeros(len(text), np.int64)
    for i in range(step):
        out = out << np.int64(bits) | np.roll(text, -first - i)
    return out


def _ranked(key: np.ndarray, wide: np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys and their dense ranks; a place takes `wide` bits, and where a key leaves these free, both are sorted as one number."""
    if int(key.max()).bit_length() + int(wide) < 64:
        sorted_ = np.sort(key << wide | np.arange(len(key)))
        order = sorted_ & ((np.int64(1) << wide) - 1)
        sorted_ >>= wide
    else:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
    return order, rank


def _turned(symbols: np.ndarray, cuts: np.ndarray, by: int) -> np.ndarray:
    """The symbol `by` places ahead of every place, each shard read in a circle."""
    return np.concatenate([np.roll(symbols[a:b], -by) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def word_names(shards: list[np.ndarray], width: int, bits: int) -> np.ndarray:
    """Numbers, in the order of the words, of the words of `width` symbols that begin at every place of the shards; those of longer words than 63 bits by doubling."""
    cuts = np.cumsum([0, *(len(x) for x in shards)])
    done = min(width, 63 // max(1, bits))
    words = np.concatenate([_packed(x, 0, done, bits) for x in shards])
    order = np.argsort(words)
    words = words[order]
    names = np.empty(len(words), np.int64)
    names[order] = np.cumsum(np.append(False, words[1:] != words[:-1]))
    while done < width:
        by = min(done, width - done)
        _, names = _ranked(names * np.int64(len(names)) + _turned(names, cuts, by), np.int64(len(names).bit_length()))
        done += by
    return names


def shard_transform(names: np.ndarray, depth: int, step: int) -> np.ndarray:
    """Suffix order of one shard by doubling from the names of its words of `step` symbols on; suffixes that agree in `depth` symbols may stand in any order."""
    n = len(names)
    wide = np.int64(n.bit_length())
    order, rank = _ranked(names, wide)
    while step < depth and rank[order[-1]] < n - 1:
        order, rank = _ranked(rank * np.int64(n) + np.roll(rank, -step), wide)
        step *= 2
    return order


def _stable(key: np.ndarray) -> np.ndarray:
    """Stable order of names below 2^32, by 16 bits at a time."""
    if key.dtype.itemsize <= 2:
        return np.argsort(key, kind="stable")
    order = np.argsort(key.astype(np.uint16), kind="stable")
    return order[np.argsort((key >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]


def merge_transforms(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards' BWTs by refining their interleave: (suffix in the shards' concatenation, common), both in merged order.

    The interleave says which shard each place of the merged order belongs to. It starts as one block,
    shard after shard; each round moves every place by the symbols before it, as many as fit a word of 63
    bits or, if these are fewer than a ROUNDS-th of `depth`, that many, stably, so after k rounds of s symbols the places are in the order of their suffixes' first k * s
    symbols and a block holds those that share them. No suffix is sorted again. A border between blocks
    keeps its place once it is there, so the round in which it appears gives `common`: the length of the
    common prefix with the suffix before, rounded down to whole rounds, and `depth` if that many symbols agree.
    """
    bits = max(int(x.max()) for x in shards).bit_length()
    rounds = min(ROUNDS, -(-depth // min(depth, 63 // max(1, bits))))
    most = -(-depth // rounds)
    cuts = np.cumsum([0, *(len(x) for x in shards)])
    ahead = word_names(shards, most, bits)
    parts = [shard_transform(ahead[a:b], depth, most) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    suffixes = np.concatenate([order + a for order, a in zip(parts, cuts[:-1], strict=True)])
    kind = np.uint8 if len(shards) < 256 else np.uint16
    interleave = np.repeat(np.arange(len(shards), dtype=kind), [len(x) for x in shards])
    size = len(suffixes)
    block, common = np.zeros(size, np.int32), np.full(size, depth, np.int32)
    open_ = np.ones(size, bool)
    common[:1], open_[:1] = 0, False
    done, names_of = 0, {}
    while done < depth:
        step = min(most, depth - done)
        if step not in names_of:  # the symbols before each place, in the shards' own orders, under names in their order
            names = _turned(ahead if step == most else word_names(shards, step, bits), cuts, -step)[suffixes]
            used = int(names.max()) + 1
            names_of[step] = names.astype(np.uint8 if used <= 1 << 8 else np.uint16 if used <= 1 << 16 else np.uint32)
        bwt = names_of[step]
        symbol = np.empty_like(bwt)
        symbol[np.argsort(interleave, kind="stable")] = bwt  # a shard's places come in its own order
        order = _stable(symbol)
        interleave, symbol, before = interleave[order], symbol[order], block[order]
        border = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        np.cumsum(border, out=block[1:])
        fresh = open_[1:] & border
        common[1:][fresh] = done
        open_[1:] &= ~border
        done += step
    merged = np.empty(size, np.int64)
    merged[np.argsort(interleave, kind="stable")] = suffixes
    return merged, common


def shards_of(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(shards, text, place): the texts as symbols (0 ends each), cut into shards of about SHARD_BYTES and two at least, and of every symbol its text and place there."""
    sizes = np.array([len(x) for x in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    present = np.bincount(raw, minlength=256) > 0
    codes = np.cumsum(present).astype(np.uint16 if present.all() else np.uint8)  # from 1
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    begins = np.cumsum(sizes + 1) - sizes - 1
    place = np.arange(len(text_of)) - begins[text_of]
    symbols = np.zeros(len(text_of), codes.dtype)
    symbols[place < sizes[text_of]] = codes[raw]
    ends = begins + sizes + 1
    most = max(1, min(SHARD_BYTES, len(symbols) // 2))
    cuts = np.unique(np.append(ends[np.flatnonzero(np.diff(ends // most, prepend=0))], len(symbols)))
    return [symbols[a:b] for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True)], text_of, place


def repeated_windows(texts: list[bytes], windows: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc, first byte, end): runs of windows of `length` bytes that an earlier (doc, start) holds too; and the number of shards merged.

    The windows looked at are those that start at the first `windows[i]` bytes of text i.
    """
    shards, text_of, place = shards_of(texts)
    merged, common = merge_transforms(shards, length)
    with_before = common >= length
    shared = with_before | np.append(with_before[1:], False)
    block = np.cumsum(~with_before)[shared]
    merged = merged[shared]
    looked = place[merged] < windows[text_of[merged]]
    merged, block = merged[looked], block[looked]
    owner = text_of[merged]
    at, doc_ = start[owner] + place[merged], doc[owner]
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
    numbers = np.unique(doc, return_inverse=True)[1]
    where = numbers[owner] << 32 | at  # in the order of (doc, start)
    again = where != np.repeat(np.minimum.reduceat(where, begin), np.diff(np.append(begin, len(where)))) if len(where) else np.zeros(0, bool)
    return *_runs(doc_[again], at[again], at[again] + length), len(shards)


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join stretches of one document that meet; all of them have to be of about one length, else some may stay apart."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1]))[: len(doc)]
    last = np.append(np.flatnonzero(new)[1:], len(doc))[: int(new.sum())] - 1
    return doc[new], start[new], end[last]


# ---- The distributed operator --------------------------------------------------------------------

_ONE = ("key", "digest", "doc", "start", "n", "settled")


def _batch(columns: list[np.ndarray], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64)) for x in columns], list(names))


def _sketch(length: int):
    """Of every stretch of windows: anchor hash, digest and place. Of equal stretches in a piece of the texts only the first two places go to the
    anchor's group; the others are settled as copies of them and are dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for text, start, n, key, digest in _stretches(*text_buffer(batch.column("text")), length):
                doc = docs[text]
                order = np.lexsort((start, doc, digest, key))
                rows = np.stack([key, digest, doc, start, n])[:, order]
                same = np.append(False, (rows[:2, 1:] == rows[:2, :-1]).all(0))[: len(order)]
                third = same & np.append(False, same[:-1])[: len(order)]
                out = rows[:, ~third]
                yield _batch([*out, np.zeros(out.shape[1])], _ONE)
                if third.any():
                    _, _, doc, start, n = rows[:, third]
                    doc, start, end = _runs(doc, start, start + n)
                    yield _batch([doc * 1_000_003 ^ start, start, doc, start, end - start, np.ones(len(doc))], _ONE)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches sorted by anchor, digest and place: those whose anchor stands in another place too. The third and later places of equal stretches are settled."""

    def told(rows: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
        return _batch([rows[0], rows[2], rows[3], rows[4], settled], ("key", "doc", "start", "n", "settled"))

    rows, decided = np.zeros((5, 0), np.int64), 0  # the last rows seen: up to two that are decided, and one that isn't

    def decide(last: bool) -> pa.RecordBatch | None:
        nonlocal rows, decided
        size = rows.shape[1]
        same = np.append(False, rows[0, 1:] == rows[0, :-1])[:size]
        again = same | np.append(same[1:], False)[:size]
        second = same & np.append(False, rows[1, 1:] == rows[1, :-1])[:size]
        third = second & np.append(False, second[:-1])[:size]
        now = np.zeros(size, bool)
        end = size if last else size - 1
        now[decided:end] = True
        now &= again
        out = told(rows[:, now], third[now])
        left = max(0, end - 2)
        rows, decided = rows[:, left:], end - left
        return out

    for batch in batches:
        part = np.stack([batch.column(x).to_numpy() for x in _ONE])
        through = part[5] == 1
        if through.any():
            yield told(part[:5, through], part[5, through])
        part = np.concatenate([rows, part[:5, ~through]], 1)
        repeat = np.append(False, (part[:4, 1:] == part[:4, :-1]).all(0))[: part.shape[1]]  # repeated rows of one document
        rows = part[:, ~repeat]
        if rows.shape[1] > decided:
            yield decide(False)
    if rows.shape[1]:
        yield decide(True)


def _packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each document's stretches (start and length in one number) that meet, in the column spans."""
    for batch in batches:
        out = []
        for packed in batch.column("spans"):
            x = np.sort(packed.values.to_numpy()) if packed.is_valid else np.zeros(0, np.int64)
            start, end = x >> 32, (x >> 32) + (x & 0xFFFFFFFF)
            reach = np.maximum.accumulate(end)
            cut = np.append(True, start[1:] > reach[:-1])[: len(x)]
            last = np.append(np.flatnonzero(cut)[1:], len(x))[: int(cut.sum())] - 1
            out.append(start[cut] << 32 | (reach[last] - start[cut]))
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(out, pa.list_(pa.int64())))


_STRETCH = "key long, doc long, start long, n long, stretch binary"
_FOUND = "doc long, start long, end long, shards long, stretch binary"


def _pieces(key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (key, doc, start, n)), pa.array(bodies, pa.binary())], ["key", "doc", "start", "n", "stretch"])


def _anchors(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each stretch's anchor: that of its first window, as all its windows chose the same."""
    joined = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(x) for x in bodies])
    begins = np.cumsum(sizes) - sizes
    h = _anchor_hashes(joined)
    at = _least(h, length - ANCHOR + 1)[begins]
    return h[at].view(np.int64), at - begins


def _cut(length: int):
    """The bytes of the stretches wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            rows = {"key": [], "doc": [], "start": [], "n": [], "bodies": []}
            held = 0

            def cut(rows: dict) -> pa.RecordBatch:
                return _pieces(*(np.concatenate(rows[x]) for x in ("key", "doc", "start", "n")), rows["bodies"])

            for i, doc in enumerate(batch.column("doc").to_pylist()):
                raw = as_bytes(batch.column("text").slice(i, 1))[0]
                keys, packed = (lists[i].values.field(x).to_numpy() for x in (0, 1))
                for a in range(0, len(packed), 10_000):
                    start, n = packed[a : a + 10_000] >> 32, packed[a : a + 10_000] & 0xFFFFFFFF
                    rows["key"].append(keys[a : a + 10_000])
                    rows["doc"].append(np.full(len(start), doc))
                    rows["start"].append(start)
                    rows["n"].append(n)
                    rows["bodies"] += [raw[x:y] for x, y in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                    held += len(start)
                    if held >= 10_000:
                        yield cut(rows)
                        rows, held = {x: [] for x in rows}, 0
            if held:
                yield cut(rows)

    return run


def _longer(length: int, windows: int):
    """Deal stretches out again: `windows` windows of one together, by the bytes that all of these share.

    Windows are counted by their distance from the anchor, so that equal windows come to equal keys.
    """
    core = length - windows + 1
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bodies = part.column("stretch").to_pylist()
                _, anchor = _anchors(bodies, length)
                key, doc, start, count, out = [], [], [], [], []
                for body, q, d, s, n in zip(bodies, anchor.tolist(), *(part.column(x).to_pylist() for x in ("doc", "start", "n")), strict=True):
                    for bucket in range((q - n + 1) // windows, q // windows + 1):  # window p stands at distance q - p
                        last = q - bucket * windows
                        a, b = max(0, last - windows + 1), min(n - 1, last)
                        key.append(digest(body[last : last + core], bucket) - (1 << 63))
                        doc.append(d)
                        start.append(s + a)
                        count.append(b - a + 1)
                        out.append(body[a : b + length])
                yield _pieces(key, doc, start, count, out)

    return run


def _resolve(length: int, crowded: int, through: bool):
    """Merge the stretches of each key that has two at least; (doc, start, end, shards) of the bytes that repeat.

    Rows of keys with more than `crowded` rows go through with their bytes. At the last level, where all
    windows of a key are equal, they are merged in pieces instead, each with the key's first row.
    """
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def found(doc: np.ndarray, start: np.ndarray, end: np.ndarray, shards: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (doc, start, end, np.full(len(doc), shards))), pa.nulls(len(doc), pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.Table] = []
        held = 0

        def merge() -> pa.RecordBatch:
            nonlocal pending, held
            rows = pa.concat_tables(pending)
            pending, held = [], 0
            n, doc, start = (rows.column(x).to_numpy() for x in ("n", "doc", "start"))
            return found(*repeated_windows(rows.column("stretch").to_pylist(), n, doc, start, length))

        first = None  # the first row of a key that comes in pieces
        for rows, piece in sorted_runs(batches, "key", crowded):
            if piece and through:
                shards = pa.nulls(rows.num_rows, pa.int64())
                yield from pa.table([rows.column("doc"), rows.column("start"), rows.column("n"), shards, rows.column("stretch")], names).to_batches()
                continue
            if piece:
                same = first is not None and first.column("key")[0] == rows.column("key")[0]
                first = first if same else rows.slice(0, 1)
                rows = pa.concat_tables([first, rows] if same else [rows])
            key = rows.column("key").to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(key)))
            shared = np.repeat(size > 1, size)
            if not shared.all():
                rows, key = rows.filter(pa.array(shared)), key[shared]
            if not len(key):
                continue
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # whole groups go into a merge
            reach = np.cumsum(rows.column("n").to_numpy() + length)[ends - 1]
            at = done = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(reach, done + MERGE_BYTES - held, "right")))
                begin_row = int(ends[at - 1]) if at else 0
                pending.append(rows.slice(begin_row, int(ends[to - 1]) - begin_row))
                held += int(reach[to - 1]) - done
                done, at = int(reach[to - 1]), to
                if held >= MERGE_BYTES // 2:
                    yield merge()
        if pending:
            yield merge()

    return run


def found_stretches(docs: DataFrame, *, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """(doc, start, end, shards) of `docs` (doc long, text): bytes that repeat an earlier place.

    shards is the number of transforms in the merge that found them; null for third and later places of
    stretches, which take the verdict of the second. Rows may overlap.
    """
    bound_batches(docs.sparkSession)
    sketch = docs.mapInArrow(_sketch(length), ", ".join(f"{x} long" for x in _ONE)).repartition("key").sortWithinPartitions("key", "digest", "doc", "start")
    found = sketch.mapInArrow(_repeated, "key long, doc long, start long, n long, settled long")
    packed, more = F.shiftleft(F.col("start"), 32) + F.col("n"), F.lit(length - 1)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.when(F.col("settled") == 0, F.struct("key", packed.alias("place")))).alias("wanted"), F.collect_list(F.when(F.col("settled") == 1, packed + more)).alias("spans"))
    by_doc = materialize(by_doc.mapInArrow(_packed_runs, "doc long, wanted array<struct<key:long,place:long>>, spans array<long>"), "anchors")
    span = F.explode("spans").alias("span")
    settled = by_doc.select("doc", span).select("doc", F.shiftright("span", 32).alias("start"), (F.shiftright("span", 32) + F.col("span").bitwiseAND(0xFFFFFFFF)).alias("end"), F.lit(None).cast("long").alias("shards"))

    def level(pieces: DataFrame, through: bool) -> DataFrame:
        dealt = pieces.repartition("key").sortWithinPartitions("key", "doc", "start")
        return materialize(dealt.mapInArrow(_resolve(length, crowded, through), _FOUND), "stretches")

    out = level(docs.join(by_doc.where(F.size("wanted") > 0).select("doc", "wanted"), "doc").mapInArrow(_cut(length), _STRETCH), True)
    removed = settled.unionByName(out.where("stretch is null").drop("stretch"))
    for windows in (RANGE, 1):
        open_ = out.where("stretch is not null")
        if open_.isEmpty():
            break
        again = open_.select("doc", "start", F.col("end").alias("n"), "stretch")
        out = level(again.mapInArrow(_longer(length, windows), _STRETCH), windows > 1)
        removed = removed.unionByName(out.where("stretch is null").drop("stretch"))
    return removed


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """(doc, spans array<long>) of `docs` (doc long, text), for documents with bytes to remove: start in the upper and length in the lower 32 bits.

    Two passes over the texts. The first sends the place, hash and digest of every stretch of windows (about
    35 bytes of text) to its anchor's group, where rows are looked at in sorted order, three at a time. The
    second sends the bytes of the distinct stretches whose anchors repeat, each with its second place at
    most, to the merges. A text of which there are many costs a group two rows a piece of the texts.
    An anchor with more than `crowded` distinct stretches is dealt out again by 89 bytes around it, and
    then window by window, where a group holds only equal windows.
    """
    packed = F.shiftleft(F.col("start"), 32) + (F.col("end") - F.col("start"))
    by_doc = found_stretches(docs, length=length, crowded=crowded).groupBy("doc").agg(F.collect_set(packed).alias("spans"))
    return by_doc.mapInArrow(_packed_runs, "doc long, spans array<long>")


#: Removed stretches of all documents, in bytes, up to which they are sent to every executor instead of shuffling the texts.
SMALL_SPANS = 24 << 20


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, text: str = "text", whole_characters: bool = False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 to `docs`, keyed by doc_id.

    Of every string of `length` bytes that occurs more than once in the corpus, only the first place
    (least doc_id, then least start) keeps its bytes. Texts are UTF-8, null is empty, no string crosses
    documents. `whole_characters` leaves characters that a removed stretch would cut. doc_id is the key:
    repeated rows with the same text are one document and come out alike; rows with a null doc_id
    are kept whole and are not compared. An existing column of a new column's name is replaced, and the text column goes.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), body.alias("text")).where("doc is not null")
    spans = materialize(repeated_spans(plain, length=length), "repeats").withColumnsRenamed({"doc": "__doc", "spans": "__spans"})
    size = spans.agg(F.sum(F.size("__spans") * 8 + 40)).first()[0] or 0
    new = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    rows = docs.drop(*new).join(F.broadcast(spans) if size <= SMALL_SPANS else spans, F.col("doc_id").cast("long") == F.col("__doc"), "left").drop("__doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, n_spans, kept = [], [], []
            bodies = as_bytes(batch.column("__text"))
            for raw, found in zip(bodies, batch.column("__spans").to_pylist(), strict=True):
                gone = [(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in found or ()]
                if whole_characters:
                    gone = [(a, b) for a, b in ((_character(raw, a, 1), _character(raw, b, -1)) for a, b in gone) if a < b]
                at, parts = 0, []
                for a, b in gone:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
                n_removed.append(sum(b - a for a, b in gone))
                n_spans.append(len(gone))
            columns = {x: batch.column(x) for x in batch.schema.names if x not in ("__spans", "__text")}
            columns |= {"n_bytes": pa.array([len(x) for x in bodies], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kept_columns = [F.col(x) for x in docs.columns if x not in new and x != text]
    rows = rows.select(*kept_columns, "__spans", F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in new and f.name != text)
    return rows.mapInArrow(run, schema + ", n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _character(raw: bytes, at: int, step: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
