"""Exact top-k search by tiled matrix products (operator 3)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import bound_batches, table
from weftgraph.storage import materialize

#: Queries sent to the executors at a time, in bytes of their vectors; more queries take more rounds.
QUERY_BYTES = 8 << 20
#: Rows of a shard tile and queries of a query tile.
TILE_ROWS, TILE_QUERIES = 4096, 512
#: Top lists merged at once in the merge tree.
FAN_IN = 32
_EXACT = 1 << 53

RESULT = "query_id long, vec_id long, score long"


def _scaled(vectors: list, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which vectors are usable, and floor(scale * x) of each as integers (objects where int64 can't hold them)."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(vectors):
        if x is not None and not np.isnan(x).any() and np.isfinite(x).all():
            by_length[len(x)].append(i)
    out = {}
    for n, rows in by_length.items():
        block = np.floor(np.array([vectors[i] for i in rows], np.float64).reshape(len(rows), n) * scale)
        if block.size and np.abs(block).max() >= 2.0**62:
            block = np.array([[int(x) for x in row] for row in block.tolist()], object).reshape(len(rows), n)
        else:
            block = block.astype(np.int64)
        out[n] = np.array(rows), block
    return out


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where every sum stays below 2^53, else in integers."""
    if queries.dtype == object or rows.dtype == object:
        exact = queries.astype(object) @ rows.astype(object).T
        return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if top < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if top < 2.0**63:
        return queries @ rows.T
    return _product(queries.astype(object), rows)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one list, ties to the smaller id, each id once; ids ascend."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, best: dict[int, list]) -> None:
    """Score one tile and keep each query's partial selection; rows are in order of id, each id once."""
    scores = _product(queries, rows)
    own = np.searchsorted(ids, query_ids)
    for q, (query, row) in enumerate(zip(query_ids.tolist(), scores, strict=True)):
        at = own[q]
        if at < len(ids) and ids[at] == query:
            found = _best(np.delete(row, at), np.delete(ids, at), k)
        else:
            found = _best(row, ids, k)
        if query in best:
            s, i = np.concatenate([best[query][0], found[0]]), np.concatenate([best[query][1], found[1]])
            i, first = np.unique(i, return_index=True)
            found = _best(s[first], i, k)
        best[query] = found


def _merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """Merge partial top lists in a tree: FAN_IN lists of a query at a time, level by level."""
    width = max(1, parts)
    while width > 1:
        width = -(-width // FAN_IN)
        group = ["query_id", F.floor(F.col("part") / FAN_IN).alias("part")]
        lists = lists.select(*group, "vec_id", "score").distinct()
        order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product of floor(scale * x).

    Queries are the rows of `is_query`; a query is compared with every row but those of its own id, ties
    go to the smaller id. Queries reach the executors in rounds of QUERY_BYTES; in a round every task
    multiplies tiles of its rows with tiles of the queries, keeps k rows a query and tile, and the
    tasks' lists merge in a tree and are written, before the next round begins. Nothing but top lists is shuffled. Vectors that are null or hold a null, NaN
    or infinity, rows without an id, and vectors of another length than the query's play no part; of rows that repeat an id with
    another vector, each counts and an id's best score stands once. Fewer rows than k give as many
    ranks as there are. Scores beyond 64 bits stop at the ends of a long.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    named = (F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(*named).where("id is not null and v is not null")
    queries = vectors.where(is_query).select(*named).where("id is not null and v is not null").where(finite)
    found: DataFrame | None = None
    for ids, values in _rounds(queries):
        shared = spark.sparkContext.broadcast((ids, values))
        lists = rows.withColumn("part", F.spark_partition_id()).mapInArrow(_searcher(shared, k, scale), f"part int, {RESULT}")
        part = materialize(_merged(lists, rows.rdd.getNumPartitions(), k), "top")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")


def _rounds(queries: DataFrame) -> Iterator[tuple[list[int], list]]:
    """Queries in rounds of bounded size, each id once (the first vector in order of values)."""
    distinct = queries.groupBy("id").agg(F.min("v").alias("v"))
    ids, values, held = [], [], 0
    for key, vector in distinct.toLocalIterator(prefetchPartitions=False):
        ids.append(key)
        values.append(vector)
        held += 8 * len(vector) + 16
        if held >= QUERY_BYTES:
            yield ids, values
            ids, values, held = [], [], 0
    if ids:
        yield ids, values


def _searcher(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = shared.value
        queries = {n: (np.array(ids, np.int64)[rows], block) for n, (rows, block) in _scaled([np.array([np.nan if y is None else y for y in x], float) for x in values], scale).items()}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        part = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                piece = batch.slice(at, TILE_ROWS)
                if not piece.num_rows:
                    continue
                part = piece.column("part")[0].as_py()
                keys = piece.column("id").to_numpy()
                for n, (rows, block) in _scaled(_vectors(piece.column("v")), scale).items():
                    if n not in queries:
                        continue
                    own = keys[rows]
                    order = np.argsort(own, kind="stable")
                    own, block = own[order], block[order]
                    turn = np.zeros(len(own), np.int64)  # rows that repeat an id go in another tile
                    for i in np.flatnonzero(own[1:] == own[:-1]) + 1:
                        turn[i] = turn[i - 1] + 1
                    for t in range(int(turn.max()) + 1):
                        here = turn == t
                        for q in range(0, len(queries[n][0]), TILE_QUERIES):
                            _tile(queries[n][0][q : q + TILE_QUERIES], queries[n][1][q : q + TILE_QUERIES], own[here], block[here], k, best)
        if best:
            lists = [(q, i, s) for q, (scores, near) in best.items() for s, i in zip(scores.tolist(), near.tolist(), strict=True)]
            q, i, s = zip(*lists, strict=True) if lists else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(q), pa.int32()), pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["part", "query_id", "vec_id", "score"])

    return run


def _vectors(column: pa.Array) -> list:
    """Each row's components as floats, a null one as NaN; a view of the column where it has no nulls."""
    values = column.flatten()
    if not column.null_count and not values.null_count:
        ends = column.offsets.to_numpy()
        flat = values.to_numpy().astype(float)
        return [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
    return [None if x is None else np.array([np.nan if y is None else y for y in x], float) for x in column.to_pylist()]


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
