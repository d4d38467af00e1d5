"""Mixing sources to target weights by balanced cube sampling (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import bound_batches, table
from weftgraph.storage import materialize

#: A source's words are taken at most so often.
MOST_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Documents of one source that one flight takes; each flight leaves two undecided for the next level.
FLIGHT = 20_000
#: Documents of a source, spread over its sizes, that the last flight leaves out to make the landing exact.
RESERVE = 12
#: Share of a source's fractional words by which the landing may miss them for a better number of documents.
NEAR = 5e-4
#: Sources up to which their table is sent to every executor instead of joined by a shuffle.
SMALL_SOURCES = 50_000
_EPS = 1e-9


def word_count(text: str) -> F.Column:
    """Number of runs of bytes other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, n_docs, source_size, target) of `sized` (source, size).

    Sources in code-point order, null last, weigh `weights` in turn and share the total size by weight.
    A target stops at `most` times its source's size and the excess goes to the others by weight until
    none is above. Ranks come from a range-partitioned sort, so no task holds all sources.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    dealt = totals.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    ranked = materialize(dealt.withColumn("part", F.spark_partition_id()), "sources")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1)
    counts = {r["part"]: r["count"] for r in ranked.groupBy("part").count().collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(before)]
        before += counts[part]
    nth = F.col("nth") + (F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0))
    weight = F.array(*(F.lit(float(x)) for x in weights))[(nth % len(weights)).cast("int")]
    table_ = materialize(ranked.select("source", "n_docs", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "sources")
    level = 0.0
    while True:  # raise the level until no further source is at its cap
        capped = F.col("weight") * level > F.col("cap")
        fixed, free, total = table_.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum("source_size")
        ).first()
        new = (float(total) - fixed) / free if free else level
        if new <= level or not free:
            break
        level = new
    return table_.select("source", "n_docs", "source_size", F.least(F.col("weight") * level, F.col("cap")).cast("double").alias("target"))


def flight(share: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase of the cube method for document and word totals: at most two shares stay fractional.

    Units are taken in order. Three undecided units hold one direction in which both totals stand still;
    the shares move along it, in one of its two senses drawn so that every share keeps its expectation,
    until one lands on 0 or 1, and the next unit takes its place.
    """
    out = share.astype(float).copy()
    draws = iter(rng.random(2 * len(out) + 8).tolist())
    active: list[tuple[int, float, float]] = []  # unit, share, size
    for i, (p, x) in enumerate(zip(out.tolist(), size.tolist(), strict=True)):
        if p <= _EPS or p >= 1 - _EPS:
            out[i] = round(p)
            continue
        active.append((i, p, float(x)))
        while len(active) == 3:
            (i0, p0, x0), (i1, p1, x1), (i2, p2, x2) = active
            d0, d1, d2 = x1 - x2, x2 - x0, x0 - x1  # sums to nothing, and so do its products with the sizes
            if not (d0 or d1 or d2):
                d0, d1 = 1.0, -1.0
            up = down = math.inf
            for p_, d in ((p0, d0), (p1, d1), (p2, d2)):
                if d > 0:
                    up, down = min(up, (1 - p_) / d), min(down, p_ / d)
                elif d < 0:
                    up, down = min(up, p_ / -d), min(down, (1 - p_) / -d)
            step = up if next(draws) * (up + down) < down else -down
            active = []
            for i_, p_, x_ in ((i0, p0 + step * d0, x0), (i1, p1 + step * d1, x1), (i2, p2 + step * d2, x2)):
                if p_ <= _EPS or p_ >= 1 - _EPS:
                    out[i_] = round(p_)
                else:
                    active.append((i_, p_, x_))
    for i_, p_, _ in active:
        out[i_] = p_
    return out


def landing(share: np.ndarray, size: np.ndarray, near: float = 0.0) -> np.ndarray:
    """Decide at most 2 + RESERVE shares together, over all their subsets.

    Of the subsets whose word total is within `near` of the shares' (or nearest, if none is), the one of nearest document total wins.
    """
    k = len(share)
    taken = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    words = np.abs(taken @ size - share @ size)
    docs = np.abs(taken.sum(1) - share.sum())
    docs[words > max(near, words.min())] = np.inf
    return taken[np.lexsort((words, docs))[0]].astype(float)


def mix(sized: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """Add source_size, target and copies to `sized` (doc_id, source, size, ...): how often the mix takes each row.

    A source's target over its size is the copies that each of its documents gets on average: the
    whole part goes to all, the fraction is a share that the cube method turns into 0 or 1, keeping
    the source's document and word totals. Flights run over at most FLIGHT documents of a source, so a
    source of any size is spread; what they leave meets in a next level; the last holds RESERVE documents back and lands with them.
    Draws depend on seed, source and the documents alone, so reruns agree whatever the partitions.
    Rows without words take part in document totals.
    Repeated rows are documents of their own. A null source is a source, a null size counts as 0. Columns
    named source_size, target or copies are replaced, others pass through whatever their names.
    """
    spark = sized.sparkSession
    bound_batches(spark)
    extra = [c for c in sized.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies")]
    names = {f"__extra{i}": c for i, c in enumerate(extra)}  # out of the way of the helper columns
    sized = sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *(F.col(f"`{c}`").alias(x) for x, c in names.items()))
    sized = materialize(sized, "sized")
    targets = materialize(source_targets(sized, weights=weights, most=most), "targets")
    right = targets.withColumnRenamed("source", "__source")
    if targets.count() <= SMALL_SOURCES:
        right = F.broadcast(right)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = sized.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + _EPS)
    rows = rows.withColumns({
        "base": whole.cast("int"), "share": F.greatest(F.col("rate") - whole, F.lit(0.0)),
        "order": F.xxhash64(F.lit(seed), "source", "doc_id", "size"), "left": F.col("n_docs"),
    })
    columns = ["doc_id", "source", "size", *names, "source_size", "target", "base", "share", "order", "left"]
    rows = rows.select(*columns)
    done: list[DataFrame] = []
    while True:
        # with `left` undecided documents in a source, its flights; one flight lands
        flights = F.ceil(F.col("left") / FLIGHT).cast("long")
        dealt = rows.withColumns({"flights": flights, "flight": F.pmod(F.col("order"), F.greatest(flights, F.lit(1)))})

        def fly(pdf: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pdf.drop(columns=["flights", "flight"])
            pdf = pdf.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
            share, size = pdf["share"].to_numpy(float), pdf["size"].to_numpy(float)
            rng = np.random.default_rng([seed & 0xFFFFFFFF, int(pdf["order"].iloc[-1]) & 0xFFFFFFFF, len(pdf)])
            last = pdf["flights"].iloc[0] <= 1
            words = float(share @ size)
            flying = np.ones(len(share), bool)
            if last:
                flying[np.unique(np.linspace(len(share) // 4, len(share) - 1, RESERVE).astype(int))] = False
            share[flying] = flight(share[flying], size[flying], rng)
            open_ = np.flatnonzero((share > _EPS) & (share < 1 - _EPS))
            if last and len(open_):
                share[open_] = landing(share[open_], size[open_], NEAR * words)
            pdf["share"] = share
            pdf["left"] = 2 * pdf["flights"]
            return pdf.drop(columns=["flights", "flight"])

        out = materialize(dealt.groupBy("source", "flight").applyInPandas(fly, rows.schema), "flights")
        open_ = (F.col("share") > _EPS) & (F.col("share") < 1 - _EPS)
        done.append(out.where(~open_))
        rows = out.where(open_)
        if rows.isEmpty():
            break
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    copies = (F.col("base") + F.round("share").cast("int")).alias("copies")
    return decided.select("doc_id", "source", "size", *(F.col(x).alias(c) for x, c in names.items()), "source_size", "target", copies)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", word_count("text").alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
