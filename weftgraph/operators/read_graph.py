"""Operators on the graph of overlapping reads."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.graph import connected_components, spanning_forest
from weftgraph.shipping import ship
from weftgraph.storage import materialize


def both_ways(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, other, ...) of an undirected edge table."""
    rest = [c for c in edges.columns if c not in (a, b)]
    ends = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))
    return edges.select(*rest, F.explode(ends).alias("e")).select(F.col("e.node").alias("node"), F.col("e.other").alias("other"), *rest)


def top_k_edges(edges: DataFrame, k: int = 6, score: str = "markers", key: str = "aid") -> DataFrame:
    """Edges (key, u, v, score) among the k best, ties to the larger key, of either end."""
    order = Window.partitionBy("node").orderBy(F.desc(score), F.desc(key))
    ranked = both_ways(edges.select(key, "u", "v", score)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return edges.join(ranked.select(key).distinct(), key, "left_semi")


def oriented_edges(alignments: DataFrame) -> DataFrame:
    """R2: two edges an alignment (aid, r0, r1, same_strand), reverse complements of each other: (eid, aid, u, v)."""
    turn = F.when(F.col("same_strand"), 0).otherwise(1)
    return alignments.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).select(
        (F.col("aid") * 2 + F.col("s")).alias("eid"), "aid", (F.col("r0") * 2 + F.col("s")).alias("u"), (F.col("r1") * 2 + F.col("s").bitwiseXOR(turn)).alias("v")
    )


def isolated(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(both_ways(edges).select(F.col("node").alias(node)), node, "left_anti")


def percentile_by_bins(values: DataFrame, column: str, low: float, high: float, bins: int, p: float) -> DataFrame:
    """(value): the middle of the first of `bins` equal bins from low to high at which the cumulative share reaches p."""
    width = (high - low) / bins
    binned = values.where((F.col(column) >= low) & (F.col(column) < high)).groupBy(F.floor((F.col(column) - low) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as bins at most
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = binned.withColumn("share", F.sum("n").over(up) / F.sum("n").over(everything))
    return running.where(F.col("share") >= p).agg((F.lit(low) + (F.min("bin") + 0.5) * width).alias("value"))


def histogram(values: DataFrame, column: str, start: float, stop: float, bins: int) -> DataFrame:
    """(bin, n) of equal-width bins; values outside are left out."""
    width = (stop - start) / bins
    inside = values.where((F.col(column) >= start) & (F.col(column) < stop))
    return inside.groupBy(F.floor((F.col(column) - start) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


#: Columns that adaptive criteria look at: whether large is good, and the histogram's bounds and bins.
CRITERIA = {"fraction": (True, 0.0, 1.0001, 100), "markers": (True, 0.0, 10000.0, 1000), "max_drift": (False, 0.0, 1000.0, 1000), "max_skip": (False, 0.0, 1000.0, 1000), "trim": (False, 0.0, 1000.0, 1000)}


def adaptive_criteria(info: DataFrame, p: float = 0.1) -> DataFrame:
    """One row with the limits at percentile p (good if large) or 1 - p (good if small)."""
    out: DataFrame | None = None
    for name, (large, low, high, bins) in CRITERIA.items():
        one = percentile_by_bins(info, name, low, high, bins, p if large else 1 - p).select(F.round("value", 6).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def meets_criteria(info: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows that keep to all five limits."""
    named = limits.select(*(F.col(c).alias(f"limit_{c}") for c in CRITERIA))
    joined = info.crossJoin(F.broadcast(named))  # one row
    for name, (large, *_rest) in CRITERIA.items():
        joined = joined.where(F.col(name) >= F.col(f"limit_{name}") if large else F.col(name) <= F.col(f"limit_{name}"))
    return joined.select(info.columns)


def read_graph(info: DataFrame, k: int = 6, p: float = 0.1) -> DataFrame:
    """Alignments that meet the adaptive criteria and are among the k best of either read."""
    return top_k_edges(meets_criteria(info, adaptive_criteria(info, p)), k)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component, size); with `nodes` (node), those without an edge too."""
    found = connected_components(edges, "u", "v")
    if nodes is not None:
        found = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("node", "component", "size")


def component_summary(found: DataFrame) -> DataFrame:
    """(component, size, rank, cumulative) of components of two or more, by descending size."""
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    order = Window.orderBy(F.desc("size"), "component")
    return sizes.withColumns({"rank": F.row_number().over(order), "cumulative": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})


def within_hops(starts: DataFrame, edges: DataFrame, hops: int, *, directed: bool = False) -> DataFrame:
    """(start, node, distance) of everything within `hops` of each start (node), itself included."""
    steps = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).distinct() if directed else both_ways(edges.select("u", "v")).distinct()
    steps = materialize(steps, "steps")
    reached = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance")).distinct()
    frontier = reached
    for d in range(1, hops + 1):
        found = frontier.join(steps, "node").select("start", F.col("other").alias("node")).distinct()
        frontier = materialize(found.join(reached, ["start", "node"], "left_anti").select("start", "node", F.lit(d).alias("distance")), "hops")
        reached = materialize(reached.unionByName(frontier), "hops")
    return reached


def shortest_path(edges: DataFrame, source: int, target: int, most: int | None = None) -> list[int]:
    """Nodes of a shortest undirected path, each step's predecessor the least; empty if there is none (within `most` hops, if given).

    The nodes of the last hop carry the path that leads to them, so a found path is there at once.
    """
    if source == target:
        return [source]
    steps = materialize(both_ways(edges.select("u", "v")).distinct(), "steps")
    front = edges.sparkSession.createDataFrame([(source, [source])], "node long, path array<long>")
    reached, hops = front.select("node"), 0
    while most is None or hops < most:
        found = front.join(steps, "node").groupBy(F.col("other").alias("node")).agg(F.min_by("path", "node").alias("path")).join(reached, "node", "left_anti")
        front = materialize(found.select("node", F.concat("path", F.array("node")).alias("path")), "path")
        goal = front.where(F.col("node") == target).first()
        if goal is not None:
            return goal["path"]
        if front.isEmpty():
            break
        reached, hops = materialize(reached.unionByName(front.select("node")), "path"), hops + 1
    return []


def _neighbourhood_edges(edges: DataFrame, hops: int) -> DataFrame:
    """(start, u, v, a, b): edges inside each node's neighbourhood, with both ends' distances."""
    nodes = both_ways(edges.select("u", "v")).select("node").distinct()
    near = within_hops(nodes, edges, hops)
    a = near.select("start", F.col("node").alias("u"), F.col("distance").alias("a"))
    b = near.select("start", F.col("node").alias("v"), F.col("distance").alias("b"))
    return edges.select("u", "v").distinct().join(a, "u").join(b, ["start", "v"])


def _find(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def chimeric(edges: DataFrame, hops: int = 2, partner=None) -> DataFrame:
    """(node): nodes whose neighbours at exactly `hops` fall apart once the node (and its `partner` strand) is taken out.

    `partner` maps a node column to the other strand's; None for data without strands.
    """
    ship(edges.sparkSession)
    local = _neighbourhood_edges(edges, hops)
    if partner is not None:
        local = local.where((F.col("u") != partner(F.col("start"))) & (F.col("v") != partner(F.col("start"))))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["start"].iloc[0]
        parent: dict = {}
        far = set()
        for u, v, a, b in zip(pdf["u"], pdf["v"], pdf["a"], pdf["b"], strict=True):
            far.update(x for x, d in ((u, a), (v, b)) if d == hops)
            if u != start and v != start:
                parent[_find(parent, u)] = _find(parent, v)
        return pd.DataFrame({"node": [start] if len({_find(parent, x) for x in far}) > 1 else []}, dtype="int64")

    return local.groupBy("start").applyInPandas(judge, "node long")


def bridges(edges: DataFrame, hops: int = 2) -> DataFrame:
    """(u, v): edges from a node to neighbours outside the largest component of its neighbourhood without it."""
    ship(edges.sparkSession)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["start"].iloc[0]
        parent: dict = {}
        near = set()
        for u, v in zip(pdf["u"], pdf["v"], strict=True):
            if start in (u, v):
                near.add(v if u == start else u)
            else:
                parent[_find(parent, u)] = _find(parent, v)
        sizes: dict = defaultdict(int)
        for x in list(parent):
            sizes[_find(parent, x)] += 1
        for x in near:
            sizes[_find(parent, x)] += 0
        if not near:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        best = max(sizes, key=lambda r: (sizes[r], -r))
        out = [(min(start, x), max(start, x)) for x in sorted(near) if _find(parent, x) != best]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return _neighbourhood_edges(edges, hops).groupBy("start").applyInPandas(judge, "u long, v long").distinct()


def separate_strands(edges: DataFrame, score: str = "markers") -> DataFrame:
    """(eid, crosses): edge pairs in order of descending score, then aid; a pair that would join a node to its other strand crosses.

    Edges (eid, aid, u, v, score) come in pairs of one aid, nodes n and n XOR 1 are two strands. In that order, a pair joins two
    parts of the read graph, and is kept, exactly if it is of the maximum spanning forest of reads; of any other pair the forest says how the strands of
    its ends lie to each other. So the forest's edges on both strands fall into two components a tree, and an edge crosses if its ends are in different ones.
    """
    strand = lambda c: F.col(c).bitwiseAND(F.lit(1).cast("long"))
    one = edges.groupBy("aid").agg(F.min_by(F.struct("u", "v"), "eid").alias("e"), F.max(score).alias("score")).select("aid", "e.u", "e.v", "score")
    turned = one.select("aid", "score", F.floor(F.col("u") / 2).alias("x"), F.floor(F.col("v") / 2).alias("y"), strand("u").bitwiseXOR(strand("v")).alias("turn")).where("x != y")
    rank = F.struct("score", (-F.col("aid")).alias("aid"))
    best = turned.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(rank).alias("rank"), F.max_by("turn", rank).alias("turn"))
    forest = materialize(spanning_forest(best, "rank"), "forest")
    cover = forest.select("a", "b", "turn", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).select((F.col("a") * 2 + F.col("s")).alias("u"), (F.col("b") * 2 + F.col("s").bitwiseXOR(F.col("turn"))).alias("v"))
    label = materialize(connected_components(cover, "u", "v"), "strands")
    side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"{x}_side"))
    placed = edges.select("eid", "u", "v").join(side("u"), "u", "left").join(side("v"), "v", "left")
    return placed.select("eid", (F.coalesce("u_side", "u") != F.coalesce("v_side", "v")).alias("crosses"))


def separate_strands_locally(edges: DataFrame, hops: int = 6, score: str = "markers") -> DataFrame:
    """separate_strands() within the parts of the graph whose nodes reach their other strand in `hops` steps."""
    nodes = both_ways(edges.select("u", "v")).select("node").distinct()
    near = within_hops(nodes, edges.select("u", "v"), hops).where(F.col("node") == F.col("start").bitwiseXOR(F.lit(1).cast("long"))).select(F.col("start").alias("node"))
    inside = edges.join(near.select(F.col("node").alias("u")), "u", "left_semi").join(near.select(F.col("node").alias("v")), "v", "left_semi")
    found = separate_strands(inside, score)
    return edges.select("eid").join(found, "eid", "left").select("eid", F.coalesce("crosses", F.lit(False)).alias("crosses"))


def triangles(edges: DataFrame, value: str | None = None) -> DataFrame:
    """(a, b, c) with a < b < c, all joined; with `value` (an offset from the lesser to the larger end) the loop's error too."""
    columns = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    if value:
        columns.append(F.when(F.col("u") <= F.col("v"), F.col(value)).otherwise(-F.col(value)).alias("w"))
    e = edges.where("u != v").select(*columns).dropDuplicates(["u", "v"])

    def named(a: str, b: str, w: str) -> DataFrame:
        return e.select(F.col("u").alias(a), F.col("v").alias(b), *([F.col("w").alias(w)] if value else []))

    found = named("a", "b", "w1").join(named("b", "c", "w2"), "b").join(named("a", "c", "w3"), ["a", "c"])
    return found.select("a", "b", "c", *([(F.col("w1") + F.col("w2") - F.col("w3")).alias("error")] if value else []))


def least_squares_positions(edges: list[tuple[int, int, float]]) -> tuple[dict[int, float], np.ndarray]:
    """Positions, the first node's 0, that fit the offsets v - u best, and each edge's residual."""
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    at = {x: i for i, x in enumerate(nodes)}
    matrix, right = np.zeros((len(edges) + 1, len(nodes))), np.zeros(len(edges) + 1)
    for k, (u, v, w) in enumerate(edges):
        matrix[k, at[v]] += 1
        matrix[k, at[u]] -= 1
        right[k] = w
    matrix[-1, 0] = 1
    solution = np.linalg.lstsq(matrix, right, rcond=None)[0]
    return dict(zip(nodes, solution.tolist(), strict=True)), (matrix @ solution - right)[:-1]


def inconsistent(edges: DataFrame, value: str = "offset", most: float = 200.0) -> DataFrame:
    """(u, v): of the edges in triangles whose loop error is `most` or more, those that a least-squares fit around the triangle can't place.

    Around each bad triangle, the worst residual goes until all are below `most`. Triangles with the same nodes around them have the same
    fit, which is made once.
    """
    spark = edges.sparkSession
    ship(spark)
    ordered = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(F.col("u") <= F.col("v"), F.col(value)).otherwise(-F.col(value)).cast("double").alias("w"))
    ordered = materialize(ordered, "ordered")
    near = materialize(both_ways(ordered.select("u", "v")).groupBy("node").agg(F.collect_set("other").alias("near")), "near")
    bad = triangles(ordered, "w").where(F.abs("error") >= most).select("a", "b", "c")
    for c in "abc":
        bad = bad.join(near.select(F.col("node").alias(c), F.col("near").alias(f"near_{c}")), c)
    around = F.array_sort(F.array_distinct(F.concat("near_a", "near_b", "near_c", F.array("a", "b", "c"))))
    graphs = materialize(bad.select(around.alias("nodes")).distinct().withColumn("graph", F.monotonically_increasing_id()), "graphs")
    member = lambda x: graphs.select("graph", F.explode("nodes").alias(x))
    local = ordered.join(member("u"), "u").join(member("v"), ["graph", "v"]).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("u", "v", "w"))).alias("rows"))
    local = local.select("rows").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))  # by number: rows are few and slow

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column("rows"):
                rows = list(zip(*(x.to_pylist() for x in held.values.flatten()), strict=True))
                while rows:
                    _, residual = least_squares_positions(rows)
                    worst = int(np.argmax(np.abs(residual)))
                    if abs(residual[worst]) < most:
                        break
                    out.append(rows.pop(worst)[:2])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return local.mapInArrow(judge, "u long, v long").distinct()


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label) by synchronous rounds: each node takes its neighbours' most frequent label, ties to the smallest.

    A node's own label counts once, which keeps two joined nodes from swapping labels for ever.
    """
    steps = both_ways(edges.select("u", "v")).distinct()
    steps = materialize(steps.unionByName(steps.select("node", F.col("node").alias("other")).distinct()), "steps")
    labels = steps.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = steps.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("best"))
        new = materialize(best.select("node", (-F.col("best.minus")).alias("label")), "labels")
        changed = not new.join(labels.withColumnRenamed("label", "old"), "node").where("label != old").isEmpty()
        labels = new
        if not changed:
            break
    return labels


def clustering_agreement(edges: DataFrame, clusterings: list[DataFrame]) -> DataFrame:
    """(u, v, agreeing): in how many clusterings (node, label) an edge's ends share a label."""
    found = edges.select("u", "v").withColumn("agreeing", F.lit(0))
    for labels in clusterings:
        a, b = labels.select(F.col("node").alias("u"), F.col("label").alias("la")), labels.select(F.col("node").alias("v"), F.col("label").alias("lb"))
        found = found.join(a, "u").join(b, "v").select("u", "v", (F.col("agreeing") + (F.col("la") == F.col("lb")).cast("int")).alias("agreeing"))
    return found


def edge_neighbourhoods(edges: DataFrame) -> DataFrame:
    """(u, v, common, only_u, only_v, between): shared and exclusive neighbours of an edge's ends, and edges between the exclusive ones."""
    steps = materialize(both_ways(edges.select("u", "v")).distinct(), "steps")
    sets = steps.groupBy("node").agg(F.collect_set("other").alias("others"))
    joined = edges.select("u", "v").distinct().join(sets.select(F.col("node").alias("u"), F.col("others").alias("nu")), "u").join(sets.select(F.col("node").alias("v"), F.col("others").alias("nv")), "v")
    own = F.array("u", "v")
    only_u, only_v = F.array_except(F.array_except("nu", "nv"), own), F.array_except(F.array_except("nv", "nu"), own)
    rows = joined.select("u", "v", F.size(F.array_intersect("nu", "nv")).cast("long").alias("common"), only_u.alias("eu"), only_v.alias("ev"))
    cross = rows.select("u", "v", F.explode("eu").alias("node"), "ev").join(steps, "node").where(F.array_contains("ev", F.col("other"))).groupBy("u", "v").agg(F.count("*").alias("between"))
    return rows.join(cross, ["u", "v"], "left").select("u", "v", "common", F.size("eu").cast("long").alias("only_u"), F.size("ev").cast("long").alias("only_v"), F.coalesce("between", F.lit(0)).cast("long").alias("between"))


def rescored(pairs: DataFrame, penalty: int = 3, least: int = 0, k: int = 6) -> DataFrame:
    """Edges (aid, u, v, matches, mismatches) by matches - penalty * mismatches^2 above `least`, the k best of either end."""
    scored = pairs.withColumn("score", F.col("matches") - penalty * F.col("mismatches") * F.col("mismatches")).where(F.col("score") > least)
    return top_k_edges(scored, k, "score")
