"""Benchmark decontamination on a positional inverted index (operator 8)."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, bound_batches, table
from weftgraph.storage import materialize

WINDOW = 13
#: Words of benchmark items handled, and sent to the executors, at a time; more items take more rounds.
SLICE_WORDS = 2_000_000
#: Words of the documents that share one shard of the index.
SHARD_WORDS = 250_000
#: Lower-cases A-Z and turns every byte that is no word byte into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "doc_id array<long>, n_words array<int>, first array<long>, n_tokens long, terms array<binary>, ends array<long>, places binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def build_index(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """A positional inverted index of every word, in shards of whole documents, one row a shard.

    Word positions run through a shard, with one free place between documents, so no phrase crosses
    from one into the next. `places` holds the sorted positions of each of `terms` (in byte order),
    `ends` where each term's list ends, `first` each document's first position. Shards are
    cut by the number of words; a longer document is a shard of its own. A null text has no words.
    """
    bound_batches(docs.sparkSession)

    def shard(rows: list[tuple[int, np.ndarray]], own: dict[bytes, int]) -> pa.RecordBatch:
        first, at = [], 0
        for _, codes in rows:
            first.append(at)
            at += len(codes) + 1
        names = sorted(own)
        rank = np.empty(len(names) + 1, np.int64)
        rank[[own[x] for x in names]] = np.arange(len(names))
        rank[-1] = -1  # the place behind a document
        codes = rank[np.concatenate([np.append(x, -1) for _, x in rows])]
        places = np.flatnonzero(codes >= 0)
        used = codes[places]
        order = np.argsort(used.astype(np.uint16) if len(names) <= 1 << 16 else used, kind="stable")
        ends = np.cumsum(np.bincount(used, minlength=len(names)))
        row = {
            "doc_id": [x for x, _ in rows], "n_words": [len(x) for _, x in rows], "first": first, "n_tokens": at,
            "terms": names, "ends": ends.tolist(), "places": places[order].astype(np.int32).tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_schema())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []
        own: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            for key, body in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = words_of(body)
                for x in set(words).difference(own):
                    own[x] = len(own)
                rows.append((key, np.fromiter(map(own.__getitem__, words), np.int64, len(words))))
                held += len(words) + 1
                if held >= SHARD_WORDS:
                    yield shard(rows, own)
                    rows, own, held = [], {}, 0
        if rows:
            yield shard(rows, own)

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(build, INDEX)


def _schema() -> pa.Schema:
    long, int_ = pa.int64(), pa.int32()
    return pa.schema([("doc_id", pa.list_(long)), ("n_words", pa.list_(int_)), ("first", pa.list_(long)), ("n_tokens", long), ("terms", pa.list_(pa.binary())), ("ends", pa.list_(long)), ("places", pa.binary())])


class _Lists:
    """The postings of one shard."""

    def __init__(self, row: dict):
        self.at = {x: i for i, x in enumerate(row["terms"])}
        self.ends = [0, *row["ends"]]
        self.places = np.frombuffer(row["places"], np.int32)

    def get(self, term: bytes) -> np.ndarray:
        i = self.at[term]
        return self.places[self.ends[i] : self.ends[i + 1]]

    def count(self, term: bytes) -> int:
        i = self.at.get(term)
        return 0 if i is None else self.ends[i + 1] - self.ends[i]

    def starts(self, phrase: tuple[bytes, ...], slop: int = 0, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Where a phrase starts: offset-adjusted lists intersected from the rarest term on.

        With slop, every other term need only stand within `slop` words of its place beside the rarest, in the same of the
        documents whose first and last places are `bounds`.
        """
        if any(x not in self.at for x in phrase):
            return np.zeros(0, np.int32)
        by_count = sorted(range(len(phrase)), key=lambda i: self.count(phrase[i]))
        found = self.get(phrase[by_count[0]]) - by_count[0]
        for i in by_count[1:]:
            if not len(found):
                break
            places = self.get(phrase[i])
            low, high = found + (i - slop), found + (i + slop)
            if slop:
                doc = np.searchsorted(bounds[0], found + by_count[0], "right") - 1
                low, high = np.maximum(low, bounds[0][doc]), np.minimum(high, bounds[1][doc])
            near = places[np.minimum(np.searchsorted(places, low), len(places) - 1)]
            found = found[(near >= low) & (near <= high)]
        return found

    def rarest(self, phrase: tuple[bytes, ...]) -> int:
        return min(range(len(phrase)), key=lambda i: self.count(phrase[i]))


def find_phrases(index: DataFrame, phrases: list[tuple[int, bytes]], slop: int = 0) -> DataFrame:
    """Rows (doc_id, phrase_id, start) of every exact (slop 0) or proximity match; a bounded list of phrases.

    A proximity match has every word within `slop` words of its place beside the phrase's rarest word (the first, of equally rare
    ones in a shard), all in one document; start is the place that the phrase would begin at there, which may lie before the document.
    """
    listed = index.sparkSession.sparkContext.broadcast([(k, tuple(words_of(x))) for k, x in phrases])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists, first, rows = _Lists(row), np.array(row["first"]), []
                bounds = first, first + np.array(row["n_words"]) - 1
                for k, phrase in listed.value:
                    rare = lists.rarest(phrase) if phrase else 0
                    for s in lists.starts(phrase, slop, bounds).tolist() if phrase else ():
                        doc = int(np.searchsorted(first, s + rare, "right")) - 1
                        rows.append((row["doc_id"][doc], k, s - int(first[doc])))
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "phrase_id", "start"), x, strict=True)) for x in rows], schema=pa.schema([("doc_id", pa.int64()), ("phrase_id", pa.int64()), ("start", pa.int64())]))

    return index.mapInArrow(search, "doc_id long, phrase_id long, start long")


def _slices(benchmark: DataFrame, text: str) -> Iterator[list[tuple[tuple[bytes, ...], tuple[int, ...]]]]:
    """Windows with their items, a bounded slice of items at a time."""
    windows: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    held = 0
    for item, body in benchmark.select("item_id", text).toLocalIterator(prefetchPartitions=False):
        if item is None or body is None:
            continue
        words = words_of(body.encode())
        if words:
            for i in range(max(1, len(words) - WINDOW + 1)):
                windows[tuple(words[i : i + WINDOW])].add(item)
        held += len(words)
        if held >= SLICE_WORDS:
            yield [(w, tuple(x)) for w, x in windows.items()]
            windows, held = defaultdict(set), 0
    if windows:
        yield [(w, tuple(x)) for w, x in windows.items()]


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Judge every document by the 13-word windows of benchmark items that occur in it.

    The index holds the positions of every word and is stored in the shared folder; each
    window's lists are intersected from its rarest word on, shard by shard, with no shuffle. An item
    of fewer words is one window, one without words none; items without an id or text are left out.
    Benchmarks over SLICE_WORDS words are searched slice by slice, hits adding up, so what goes to
    the executors at once is bounded. Repeated rows of documents are judged each; doc_id holds their `key`. An empty benchmark
    leaves every document clean; other columns of both tables play no part.
    """
    spark = docs.sparkSession
    index = materialize(build_index(docs.select(F.col(key).cast("long").alias("doc_id"), text), text=text), "index")
    hits = index.select("*", F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("binary").alias("items"))
    shared = None
    schema = pa.schema([*_schema(), ("hit", pa.binary()), ("items", pa.binary())])

    def searcher(shared, last: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    lists, first = _Lists(row), np.array(row["first"])
                    hit = np.zeros(row["n_tokens"], bool) if row["hit"] is None else np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=row["n_tokens"]).astype(bool)
                    items = set() if row["items"] is None else set(map(tuple, np.frombuffer(row["items"], np.int64).reshape(-1, 2).tolist()))
                    for window, owners in shared.value if shared is not None else ():
                        starts = lists.starts(window)
                        if len(starts):
                            for k in range(len(window)):
                                hit[starts + k] = True
                            for doc in np.unique(np.searchsorted(first, starts, "right") - 1).tolist():
                                items.update((doc, x) for x in owners)
                    row |= {"hit": np.packbits(hit).tobytes(), "items": np.array(sorted(items), np.int64).tobytes()}
                    yield _judged(row) if last else pa.RecordBatch.from_pylist([row], schema=schema)

        return search

    for windows in _slices(benchmark, text):
        if shared is not None:  # another slice: what the one before found is written first
            hits = materialize(hits.mapInArrow(searcher(shared, False), f"{INDEX}, hit binary, items binary"), "hits")
            shared.destroy()
        shared = spark.sparkContext.broadcast(windows)
    return hits.mapInArrow(searcher(shared, True), RESULT)


def _judged(row: dict) -> pa.RecordBatch:
    n_words = np.array(row["n_words"], np.int64)
    n_hit = np.zeros(len(n_words), np.int64)
    if row["hit"] is not None and row["n_tokens"]:
        hit = np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=row["n_tokens"]).astype(np.int64)
        n_hit = np.add.reduceat(hit, np.array(row["first"]))
    found: dict[int, list[str]] = defaultdict(list)
    if row["items"]:
        for doc, item in np.frombuffer(row["items"], np.int64).reshape(-1, 2).tolist():
            found[doc].append(str(item))
    items = [sorted(found.get(i, ())) for i in range(len(n_words))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["doc_id"], pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
        ],
        [x.split()[0] for x in RESULT.split(", ")],
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
