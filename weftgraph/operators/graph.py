"""Shared graph algorithms on edge tables: components, hops, pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every vertex of an undirected edge table with its component's least vertex.

    Large-star and small-star steps alternate until the edge set no longer changes; every round is
    written to the shared folder, so plans stay short and a lost executor costs one round. Null ends
    are ignored; a self-loop is a component of its own. Returns (node, component).
    """
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    raw = materialize(raw.distinct(), "cc")
    loops = raw.where("u = v").select(F.col("u").alias("node")).distinct()
    star = raw.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        old, star = star, materialize(small, "cc")
        discard(old)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labelled = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = labelled.unionByName(roots)
    alone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone)


def strong_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Label the vertices of a directed edge table that lie on a circle with the least vertex of their strongly connected component.

    Vertices that no edge enters or leaves are peeled off until none is left. In what remains, the least vertex that reaches each vertex spreads
    along the edges; of the vertices with equal labels those that lead back to it are its component, which then goes, and so on.
    Self-loops don't count. Returns (node, component) of components of two or more vertices.
    """
    rest = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "strong")
    kind = dict(rest.dtypes)["u"]
    found = rest.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    while True:
        n = rest.count()
        while n:
            core = rest.join(rest.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(rest.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
            old, rest = rest, materialize(core.select("u", "v"), "strong")
            discard(old)
            m = rest.count()
            if m == n:
                break
            n = m
        if not n:
            return found
        label = materialize(rest.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label")), "strong")
        while True:
            come = rest.join(label.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("least"))
            new = materialize(label.join(come, "node").select("node", F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("less")), "strong")
            discard(label)
            label = new.select("node", "label")
            if new.where("less").isEmpty():
                break
        same = rest.join(label.select(F.col("node").alias("u"), "label"), "u").join(label.select(F.col("node").alias("v"), F.col("label").alias("other")), "v").where("label = other")
        same = materialize(same.select("u", "v", "label"), "strong")
        back = materialize(label.where("node = label").select("node", F.col("label").alias("component")), "strong")
        known = back.count()
        while True:
            more = same.join(back, (F.col("v") == F.col("node")) & (F.col("label") == F.col("component"))).select(F.col("u").alias("node"), "component")
            old, back = back, materialize(back.unionByName(more).distinct(), "strong")
            discard(old)
            if (count := back.count()) == known:
                break
            known = count
        found = materialize(found.unionByName(back.join(back.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component", "left_semi").select("node", "component")), "strong")
        done = back.select("node")
        old, rest = rest, materialize(rest.join(done.withColumnRenamed("node", "u"), "u", "left_anti").join(done.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"), "strong")
        discard(old, same)


def spanning_forest(edges: DataFrame, score: str = "log_p") -> DataFrame:
    """The maximum spanning forest of edges (a, b, score, ...) by rounds of best edges of components (Boruvka).

    Equal scores go by (a, b), so the forest is unique and that of sorted greedy insertion.
    """
    edges = materialize(edges, "forest")
    rank = F.struct(F.col(score).alias("s"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
    # what is left between components, under their labels; a round works on the last one's components alone
    left = edges.where("a != b").select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), rank.alias("rank"))
    chosen: list[DataFrame] = []
    while True:
        ends = left.select(F.explode(F.array("ca", "cb")).alias("c"), "rank", F.struct("a", "b", "ca", "cb").alias("e"))
        best = materialize(ends.groupBy("c").agg(F.max_by("e", "rank").alias("e")).select("e.*").distinct(), "forest")
        if best.isEmpty():
            break
        chosen.append(best.select("a", "b"))
        parts = materialize(connected_components(best, "ca", "cb"), "forest")
        la, lb = parts.select(F.col("node").alias("ca"), F.col("component").alias("na")), parts.select(F.col("node").alias("cb"), F.col("component").alias("nb"))
        left = left.join(la, "ca").join(lb, "cb").where("na != nb").select("a", "b", F.col("na").alias("ca"), F.col("nb").alias("cb"), "rank")
        left = materialize(left, "forest")
    if not chosen:
        return edges.limit(0)
    found = chosen[0]
    for more in chosen[1:]:
        found = found.unionByName(more)
    return edges.join(found, ["a", "b"]).select(edges.columns)
