"""Ranked lexical search, score at a time over impact-ordered postings (operator 12)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import as_bytes, bound_batches, table
from weftgraph.llm.decontaminate import words_of
from weftgraph.storage import discard, materialize

#: Terms of the documents that share one shard of the index.
SHARD_TERMS = 1_000_000
#: Shards, of some 10 MB each, that a task holds at a time when it writes or reads the index.
GROUP_SHARDS = 1
#: Query terms that are sent to the executors, and searched, at a time; more items take more rounds.
SLICE_TERMS = 400_000
#: Postings of the first step of a search; each further step takes twice as many as the one before.
FIRST_STEP = 256
#: A shard's search stops once this many times k documents at most may still come in.
FEW = 4

_COUNTED = "shard long, doc_id array<long>, lengths array<int>, terms array<binary>, ends array<long>, docs binary, tfs binary"
_RANKED = "shard long, doc_id array<long>, terms array<binary>, ends array<long>, docs binary, impacts binary, by_doc binary, places binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def count_terms(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Shards of whole documents with the counted postings of every term: documents by term, and each one's occurrences (tf).

    A shard is one row; it is cut by the number of terms, and a longer document is a shard of its own. Documents without a term are left out.
    """
    bound_batches(docs.sparkSession)

    def shard(number: int, rows: list[tuple[int | None, np.ndarray]], own: dict[bytes, int]) -> pa.RecordBatch:
        names = sorted(own)
        rank = np.empty(len(names), np.int64)
        rank[[own[x] for x in names]] = np.arange(len(names))
        lengths = np.array([len(x) for _, x in rows])
        codes = rank[np.concatenate([x for _, x in rows])] * len(rows) + np.repeat(np.arange(len(rows)), lengths)
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        pairs, tfs = codes[first], np.diff(np.append(first, len(codes)))
        row = {
            "shard": number, "doc_id": [x for x, _ in rows], "lengths": lengths.tolist(), "terms": names,
            "ends": np.cumsum(np.bincount(pairs // len(rows), minlength=len(names))).tolist(),
            "docs": (pairs % len(rows)).astype(np.int32).tobytes(), "tfs": tfs.astype(np.int32).tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_schema(_COUNTED))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows: list[tuple[int | None, np.ndarray]] = []
        own: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            for doc, body in zip(batch.column("key").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if words := words_of(body):
                    for x in set(words).difference(own):
                        own[x] = len(own)
                    rows.append((doc, np.fromiter(map(own.__getitem__, words), np.int64, len(words))))
                    held += len(words)
                if held >= shard_terms:
                    yield shard(number, rows, own)
                    rows, own, held, number = [], {}, 0, number + 1
        if rows:
            yield shard(number, rows, own)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(build, _COUNTED)


def impact_index(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """count_terms()' shards with every term's postings grouped by exact impact, highest first, and the same postings by document.

    A posting's impact is (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, all in 64-bit integers.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
                ends = np.array(row["ends"])
                terms = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                m = 75 + (25 * np.array(row["lengths"], np.int64) * n_docs) // n_terms
                impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[docs])
                order = np.lexsort((docs, -impacts, terms))
                docs, impacts, terms = docs[order], impacts[order], terms[order]
                by_doc = np.lexsort((terms, docs))
                out = {
                    "shard": row["shard"], "doc_id": row["doc_id"], "terms": row["terms"], "ends": row["ends"], "docs": docs.tobytes(), "impacts": impacts.astype(np.int32).tobytes(),
                    "by_doc": by_doc.astype(np.int32).tobytes(), "places": np.cumsum(np.bincount(docs, minlength=len(row["doc_id"]))).astype(np.int64).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([out], schema=_schema(_RANKED))

    return counted.mapInArrow(rank, _RANKED)


class _Shard:
    """One shard of the impact-ordered index."""

    def __init__(self, row: dict):
        self.ids = row["doc_id"]
        self.at = {x: i for i, x in enumerate(row["terms"])}
        self.ends = [0, *row["ends"]]
        self.docs, self.impacts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["impacts"], np.int32)
        self.by_doc, self.places = np.frombuffer(row["by_doc"], np.int32), [0, *np.frombuffer(row["places"], np.int64).tolist()]
        self.term_of = np.repeat(np.arange(len(row["terms"])), np.diff(self.ends))
        self.acc = np.zeros(len(self.ids), np.int64)

    def whole(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The complete scores of a few documents, from their postings; weights by term of the shard."""
        out = np.zeros(len(docs), np.int64)
        for i, d in enumerate(docs.tolist()):
            own = self.by_doc[self.places[d] : self.places[d + 1]]
            out[i] = (weights[self.term_of[own]] * self.impacts[own]).sum()
        return out

    def best(self, terms: list[tuple[bytes, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of this shard, and their scores, among which are all of the k best that score `floor` at least (and above 0).

        Groups of equal contribution (weight times impact) are taken in descending order, over all terms of
        the query; every term bounds what it can still give by its next group. Once the bounds together can't lift a
        document that no group has named to the least score asked, and only few named ones can still reach it, the rest of
        the groups is left, and those few are scored from their own postings.
        """
        terms = [(self.at[t], w) for t, w in terms if w and t in self.at]
        none = np.zeros(0, np.int64)
        if not terms:
            return none, none
        spans = [(self.ends[t], self.ends[t + 1]) for t, _ in terms]
        if sum(w * int(self.impacts[a]) for (_, w), (a, _) in zip(terms, spans, strict=True)) < floor:
            return none, none
        docs = np.concatenate([self.docs[a:b] for a, b in spans])
        gives = np.concatenate([w * self.impacts[a:b].astype(np.int64) for (_, w), (a, b) in zip(terms, spans, strict=True)])
        term = np.repeat(np.arange(len(terms)), [b - a for a, b in spans])
        order = np.argsort(-gives, kind="stable")
        docs, gives, term = docs[order], gives[order], term[order]
        cuts, step = [0], FIRST_STEP
        while cuts[-1] < len(gives):  # a step ends where a group of equal contributions does
            stop = min(cuts[-1] + step, len(gives))
            cuts.append(int(np.searchsorted(-gives, -gives[stop - 1], "right")))
            step *= 2
        ahead = np.zeros((len(cuts), len(terms)), np.int64)
        np.maximum.at(ahead, (np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), term), gives)
        left = np.maximum.accumulate(ahead[::-1])[::-1].sum(1)  # what all terms can still give, before each step
        acc, least = self.acc, max(floor, 1)
        acc[:] = 0
        for a, b, rest in zip(cuts[:-1], cuts[1:], left[1:].tolist(), strict=True):
            np.add.at(acc, docs[a:b], gives[a:b])
            named = np.flatnonzero(acc)
            if len(named) >= k:
                least = max(least, int(np.partition(acc, len(acc) - k)[len(acc) - k]))
            if rest < least:  # no document that isn't named yet can come in
                able = named[acc[named] + rest >= least]
                if not rest:
                    return able, acc[able]
                if len(able) <= FEW * k:
                    break
        weights = np.zeros(len(self.ends) - 1, np.int64)
        for t, w in terms:
            weights[t] = w
        scores = self.whole(able, weights)
        keep = scores >= least
        return able[keep], scores[keep]


def _order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or 0))


def _query_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item, item_id, terms): every item with a term, numbered, and its terms with their repeats."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(words_of(x)) for x in as_bytes(batch.column("text"))]
            terms = [[{"term": t, "n": n} for t, n in sorted(x.items())] for x in counted]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(terms, pa.list_(pa.struct([("term", pa.binary()), ("n", pa.int64())])))], ["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(read, "item long, item_id long, terms array<struct<term: binary, n: long>>").where("size(terms) > 0")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 20, text: str = "text", doc_key: str = "doc_id", item_key: str = "item_id", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The k best documents of every item: (item_id, rank, doc_id, score), with score above 0, equal scores by ascending doc_id, null last.

    The documents become an impact-ordered index in the shared folder, shard by shard, without a shuffle; document
    frequencies are summed for the items' terms only. A task keeps each item's best documents over all its shards, so what it
    has found bounds later shards, and tasks' lists are merged by item. Items are sent to the executors SLICE_TERMS
    distinct terms at a time and then searched in the index, so what is sent is bounded.

    Every row of both tables stands for itself: repeated rows, and rows of equal or null ids, are ranked each, and of an item that
    stands twice there are two lists of ranks. A null or empty text has no terms: such a document isn't counted and such
    an item has no rows. Without documents or items the result is empty. Other columns play no part.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    counted = materialize(count_terms(docs, text=text, key=doc_key, shard_terms=shard_terms), "counted", group_rows=GROUP_SHARDS)
    queries = materialize(_query_terms(items, text, item_key), "items")
    total = counted.agg(F.sum(F.size("doc_id").cast("long")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_terms = (int(x or 0) for x in total)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_docs:
        return empty
    index = materialize(impact_index(counted, n_docs, n_terms), "impacts", group_rows=GROUP_SHARDS)
    wanted = queries.select(F.explode("terms").alias("t")).select("t.term").distinct()
    held = counted.select(F.explode(F.arrays_zip("terms", F.transform("ends", lambda x, i: x - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("n"))).alias("t"))
    df = held.select("t.terms", F.col("t.n").alias("n")).join(wanted, F.col("terms") == F.col("term"), "left_semi").groupBy(F.col("terms").alias("term")).agg(F.sum("n").alias("df"))
    df = materialize(df, "frequencies")
    discard(counted)
    weighed = queries.select("item", "item_id", F.explode("terms").alias("t")).select("item", "item_id", "t.term", "t.n").join(df, "term")
    weighed = weighed.groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "n", "df")).alias("terms"))
    weighed = materialize(weighed, "weighed")

    def slices() -> Iterator[list]:
        part, n = [], 0
        for row in weighed.orderBy("item").toLocalIterator():
            terms = [(bytes(x["term"]), x["n"] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x["df"] + 1)))) for x in row["terms"]]
            part.append((row["item"], terms))
            n += len(terms)
            if n >= SLICE_TERMS:
                yield part
                part, n = [], 0
        if part:
            yield part

    def searcher(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = _Shard(batch.slice(i, 1).to_pylist()[0])
                    for item, terms in shared.value:
                        have = best.get(item, [])
                        found, scores = shard.best(terms, k, have[-1][1] if len(have) == k else 1)
                        if len(found):
                            have = have + [(shard.ids[d], s) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
                            best[item] = _order(have)[:k]
            rows = [{"item": item, "doc_id": d, "score": s} for item, have in best.items() for d, s in have]
            yield pa.RecordBatch.from_pylist(rows, schema=_schema("item long, doc_id long, score long"))

        return search

    found = None
    for part in slices():
        shared = spark.sparkContext.broadcast(part)
        new = materialize(index.mapInArrow(searcher(shared), "item long, doc_id long, score long"), "found")
        shared.destroy()
        found = new if found is None else found.unionByName(new)
    discard(index, df, weighed)
    if found is None:
        return empty
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
