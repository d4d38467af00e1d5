"""Operators on the compressed assembly graph."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.graph import connected_components
from weftgraph.operators.marker_graph import degrees
from weftgraph.shipping import ship
from weftgraph.storage import materialize


def linear_chains(edges: DataFrame) -> DataFrame:
    """B1: (eid, chain, position): maximal unbranched paths of edges (eid, src, dst), found by pointer doubling.

    An edge goes on to the next where its end has one in- and one out-edge. A chain is named by its first edge, a circle by its least,
    which is also where it starts. Each doubling is one join; a chain of n edges needs log2 n.
    """
    inner = degrees(edges).where("in_degree = 1 and out_degree = 1").select("node")
    a, b = edges.select("eid", F.col("dst").alias("node")), edges.select(F.col("eid").alias("next"), F.col("src").alias("node"))
    steps = materialize(a.join(inner, "node").join(b, "node").select("eid", "next"), "chain-steps")
    # each edge points back to an edge `far` before it; `least` is the smallest edge passed on the way
    hops = edges.select("eid").join(steps.select(F.col("next").alias("eid"), F.col("eid").alias("before")), "eid", "left")
    hops = hops.select("eid", "before", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("far"), F.least("eid", F.coalesce("before", "eid")).alias("least"), F.when(F.col("before").isNull(), F.col("eid")).alias("root"))
    hops = materialize(hops, "chain")
    total = edges.count()
    reach = 1
    while reach < 2 * total and not hops.where("before is not null").isEmpty():
        right = hops.select(F.col("eid").alias("before"), F.col("before").alias("before2"), F.col("far").alias("far2"), F.col("least").alias("least2"), F.col("root").alias("root2"))
        joined = hops.where("before is not null").join(right, "before").select("eid", F.col("before2").alias("before"), (F.col("far") + F.col("far2")).alias("far"), F.least("least", "least2").alias("least"), F.col("root2").alias("root"))
        hops = materialize(joined.unionByName(hops.where("before is null")), "chain")
        reach *= 2
    straight = hops.where("before is null").select("eid", F.col("root").alias("chain"), F.col("far").alias("position"))
    circles = hops.where("before is not null").select("eid", F.col("least").alias("chain"))
    if circles.isEmpty():
        return straight
    # a circle's edges, from the least on: cut before it and double again
    inside = steps.join(circles, "eid")
    cut = inside.where(F.col("next") != F.col("chain")).select("eid", "next", "chain")
    place = circles.where("eid = chain").select("eid", "chain", F.lit(0).cast("long").alias("position"))
    jump = cut
    width = 1
    while True:
        grown = place.join(jump.select("eid", "next"), "eid").select(F.col("next").alias("eid"), "chain", (F.col("position") + width).alias("position"))
        if grown.isEmpty():
            break
        place = materialize(place.unionByName(grown), "circle")
        jump = materialize(jump.select("eid", F.col("next").alias("mid"), "chain").join(jump.select(F.col("eid").alias("mid"), "next"), "mid").select("eid", "next", "chain"), "circle")
        width *= 2
    return straight.unionByName(place)


def compress(edges: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """B1: (chain, src, dst, path array<eid>, length): one edge a chain."""
    chains = linear_chains(edges) if chains is None else chains
    rows = edges.select("eid", "src", "dst").join(chains, "eid")
    return rows.groupBy("chain").agg(
        F.min_by("src", "position").alias("src"), F.max_by("dst", "position").alias("dst"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "eid"))), lambda x: x["eid"]).alias("path"), F.count("*").alias("length"),
    )


def chain_coverage(edges: DataFrame, chains: DataFrame, vertex_coverage: DataFrame) -> DataFrame:
    """B2: (chain, min_coverage, avg_coverage, max_coverage) over a chain's inner vertices (vid, coverage); 0 for a single edge."""
    rows = edges.join(chains, "eid").join(vertex_coverage.select(F.col("vid").alias("src"), "coverage"), "src")
    inner = F.when(F.col("position") > 0, F.col("coverage"))
    return rows.groupBy("chain").agg(
        F.coalesce(F.min(inner), F.lit(0)).alias("min_coverage"), F.round(F.coalesce(F.avg(inner), F.lit(0.0)), 6).alias("avg_coverage"), F.coalesce(F.max(inner), F.lit(0)).alias("max_coverage")
    )


def edge_table(compressed: DataFrame) -> DataFrame:
    """(eid, chain, position) of the marker edges in compressed edges."""
    return compressed.select("chain", F.posexplode("path").alias("position", "eid")).select("eid", "chain", "position")


def low_coverage_cross_edges(edges: DataFrame, most_coverage: float) -> DataFrame:
    """(eid): in order of coverage, then eid, edges of at most most_coverage whose source has another out-edge and target another in-edge left.

    Whether an edge goes depends on the earlier ones at its source and target alone. So every round decides all edges that are first
    at both, which are no two at one vertex, and takes them out of the degrees; edges whose source or target has one edge left stay. The result is that of one edge after the other.
    """
    out = materialize(edges.groupBy("src").agg(F.count("*").alias("n_out")), "degrees")
    into = materialize(edges.groupBy("dst").agg(F.count("*").alias("n_in")), "degrees")
    order = F.struct("coverage", "eid")
    open_ = edges.where(F.col("coverage") <= most_coverage).select("eid", "src", "dst", "coverage")
    gone: list[DataFrame] = []
    while True:
        able = materialize(open_.join(out.where("n_out > 1").select("src"), "src", "left_semi").join(into.where("n_in > 1").select("dst"), "dst", "left_semi"), "cross")
        if able.isEmpty():
            break
        a, b = able.groupBy("src").agg(F.min(order).alias("sf")), able.groupBy("dst").agg(F.min(order).alias("tf"))
        ready = materialize(able.join(a, "src").join(b, "dst").where((F.col("sf") == order) & (F.col("tf") == order)).select("eid", "src", "dst"), "cross")
        gone.append(ready.select("eid"))
        open_ = able.join(ready.select("eid"), "eid", "left_anti")
        out = materialize(out.join(ready.select("src").withColumn("less", F.lit(1)), "src", "left").select("src", (F.col("n_out") - F.coalesce("less", F.lit(0))).alias("n_out")), "degrees")
        into = materialize(into.join(ready.select("dst").withColumn("less", F.lit(1)), "dst", "left").select("dst", (F.col("n_in") - F.coalesce("less", F.lit(0))).alias("n_in")), "degrees")
    found = edges.select("eid").limit(0)
    for x in gone:
        found = found.unionByName(x)
    return found


def prune_short_leaves(compressed: DataFrame, least_length: int) -> DataFrame:
    """Take away dead-end chains shorter than least_length, compress what is left, until nothing changes.

    A sweep judges all chains before it, and takes them together. Chains are (chain, src, dst, path, length); a chain's length adds up when chains join.
    """
    left = compressed.select(F.col("chain").alias("eid"), "src", "dst", "path")
    while True:
        d = degrees(left)
        marked = left.join(d.select(F.col("node").alias("src"), F.col("in_degree").alias("i")), "src").join(d.select(F.col("node").alias("dst"), F.col("out_degree").alias("o")), "dst")
        short = marked.where((F.size("path") < least_length) & ((F.col("i") == 0) | (F.col("o") == 0))).select("eid")
        if short.isEmpty():
            return left.select(F.col("eid").alias("chain"), "src", "dst", "path", F.size("path").cast("long").alias("length"))
        kept = materialize(left.join(short, "eid", "left_anti"), "leaves")
        chains = materialize(linear_chains(kept), "leaves")
        joined = kept.join(chains, "eid").groupBy("chain").agg(
            F.min_by("src", "position").alias("src"), F.max_by("dst", "position").alias("dst"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"])).alias("path"),
        )
        left = materialize(joined.select(F.col("chain").alias("eid"), "src", "dst", "path"), "leaves")


def tangle_matrices(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(eid, in_eid, out_eid, common): around each edge between a join and a fork, the members that in- and out-edges share.

    A tangle edge's source has it as its only out-edge and two or more in-edges, its target likewise the other way round, and
    no edge leads back. `members` (eid, member) tells which reads are on an edge.
    """
    d = degrees(edges)
    s = d.select(F.col("node").alias("src"), F.col("in_degree").alias("si"), F.col("out_degree").alias("so"))
    t = d.select(F.col("node").alias("dst"), F.col("in_degree").alias("ti"), F.col("out_degree").alias("to"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    tangles = edges.join(s, "src").join(t, "dst").where("so = 1 and ti = 1 and si >= 2 and to >= 2").join(back, ["src", "dst"], "left_anti").select("eid", "src", "dst")
    ins = tangles.select("eid", F.col("src").alias("node")).join(edges.select(F.col("eid").alias("in_eid"), F.col("dst").alias("node")), "node").drop("node")
    outs = tangles.select("eid", F.col("dst").alias("node")).join(edges.select(F.col("eid").alias("out_eid"), F.col("src").alias("node")), "node").drop("node")
    m = members.select("eid", "member").distinct()
    a = ins.join(m.withColumnRenamed("eid", "in_eid"), "in_eid")
    b = outs.join(m.withColumnRenamed("eid", "out_eid"), "out_eid")
    counts = a.join(b, ["eid", "member"]).groupBy("eid", "in_eid", "out_eid").agg(F.count("*").alias("common"))
    return ins.join(outs, "eid").join(counts, ["eid", "in_eid", "out_eid"], "left").select("eid", "in_eid", "out_eid", F.coalesce("common", F.lit(0)).cast("long").alias("common"))


def solvable_strictly(matrices: DataFrame) -> DataFrame:
    """(eid, priority) of square tangles with one non-zero element in each row and column; priority is the least of them."""
    rows = matrices.groupBy("eid", "in_eid").agg(F.count_if(F.col("common") > 0).alias("n"))
    columns = matrices.groupBy("eid", "out_eid").agg(F.count_if(F.col("common") > 0).alias("n"))
    r = rows.groupBy("eid").agg(F.count("*").alias("ins"), F.bool_and(F.col("n") == 1).alias("rows"))
    c = columns.groupBy("eid").agg(F.count("*").alias("outs"), F.bool_and(F.col("n") == 1).alias("columns"))
    p = matrices.where("common > 0").groupBy("eid").agg(F.min("common").alias("priority"))
    return r.join(c, "eid").join(p, "eid").where("ins = outs and rows and columns").select("eid", "priority")


def solvable_by_dominance(matrices: DataFrame, *, least_diagonal: int = 1, most_off: int = 2, most_ratio: float = 0.3) -> DataFrame:
    """(eid, in_eid, out_eid, common): the matches of tangles that resolve: each row's strict maximum is its column's too and they form a
    permutation; matches are at least least_diagonal, every other element at most most_off or most_ratio of both its row's and its column's match.
    """
    by_row, by_col = Window.partitionBy("eid", "in_eid"), Window.partitionBy("eid", "out_eid")
    m = matrices.withColumns({"rmax": F.max("common").over(by_row), "cmax": F.max("common").over(by_col)})
    m = m.withColumns({"rties": F.count_if(F.col("common") == F.col("rmax")).over(by_row), "cties": F.count_if(F.col("common") == F.col("cmax")).over(by_col)})
    match = (F.col("common") == F.col("rmax")) & (F.col("common") == F.col("cmax")) & (F.col("rties") == 1) & (F.col("cties") == 1)
    m = m.withColumn("match", match)
    off_ok = (F.col("common") <= most_off) | ((F.col("common") <= most_ratio * F.col("rmax")) & (F.col("common") <= most_ratio * F.col("cmax")))
    fine = m.groupBy("eid").agg(
        F.countDistinct("in_eid").alias("ins"), F.countDistinct("out_eid").alias("outs"), F.count_if("match").alias("matches"),
        F.bool_and(F.when(F.col("match"), F.col("common") >= least_diagonal).otherwise(off_ok)).alias("ok"),
    ).where("ins = outs and matches = ins and ok")
    return m.where("match").join(fine.select("eid"), "eid").select("eid", "in_eid", "out_eid", "common")


def detangle(edges: DataFrame, members: DataFrame, *, strict: bool = True, **limits: float) -> tuple[DataFrame, DataFrame]:
    """Resolve tangles, best priority first, until none is left: new (edges, members); `limits` are those of solvable_by_dominance().

    A resolved tangle's edge and its in- and out-edges give way to one edge a match, with the members common to both sides. In
    a round, of tangles that touch a common edge only the one of best priority (then least eid) is resolved, which is the order one by one.
    """
    edges, members = materialize(edges.select("eid", "src", "dst"), "detangle"), materialize(members.select("eid", "member").distinct(), "detangle")
    while True:  # every round takes an edge between a join and a fork away
        matrices = materialize(tangle_matrices(edges, members), "detangle")
        found = solvable_by_dominance(matrices, **limits) if not strict else matrices.where("common > 0").join(solvable_strictly(matrices).select("eid"), "eid")
        found = materialize(found, "detangle")
        if found.isEmpty():
            break
        rank = found.groupBy("eid").agg(F.min("common").alias("priority"))
        touched = found.select("eid", F.explode(F.array("eid", "in_eid", "out_eid")).alias("used")).distinct().join(rank, "eid")
        best = touched.withColumn("first", F.row_number().over(Window.partitionBy("used").orderBy(F.desc("priority"), "eid")))
        chosen = best.groupBy("eid").agg(F.max("first").alias("worst")).where("worst = 1").select("eid")
        take = materialize(found.join(chosen, "eid"), "detangle")
        top = edges.agg(F.max("eid")).first()[0]
        order = Window.orderBy("eid", "in_eid")  # a round's matches, few beside the edges
        new = take.withColumn("new", F.row_number().over(order) + F.lit(top))
        new = new.join(edges.select(F.col("eid").alias("in_eid"), "src"), "in_eid").join(edges.select(F.col("eid").alias("out_eid"), "dst"), "out_eid")
        a, b = members.withColumnsRenamed({"eid": "in_eid"}), members.withColumnsRenamed({"eid": "out_eid"})
        common = new.join(a, "in_eid").join(b, ["out_eid", "member"]).select(F.col("new").alias("eid"), "member")
        gone = take.select(F.explode(F.array("eid", "in_eid", "out_eid")).alias("eid")).distinct()
        edges_, members_ = edges.join(gone, "eid", "left_anti"), members.join(gone, "eid", "left_anti")
        edges = materialize(edges_.unionByName(new.select(F.col("new").alias("eid"), "src", "dst")), "detangle")
        members = materialize(members_.unionByName(common), "detangle")
    return edges, members


def members_of_chains(compressed: DataFrame, intervals: DataFrame) -> DataFrame:
    """(chain, oriented_id, n): how often each read is on a compressed edge; intervals has (eid, oriented_id)."""
    return edge_table(compressed).join(intervals, "eid").groupBy("chain", "oriented_id").agg(F.count("*").alias("n"))


def pseudo_paths(visits: DataFrame, owner: str, order: list[str], segment: str) -> DataFrame:
    """(owner, idx, segment, n): each owner's visits in order, repeats of a segment in a row merged."""
    by = Window.partitionBy(owner).orderBy(*order)
    opens = visits.withColumn("open", F.coalesce(F.col(segment) != F.lag(segment).over(by), F.lit(True)).cast("int"))
    runs = opens.withColumn("idx", F.sum("open").over(by) - 1)
    return runs.groupBy(owner, "idx").agg(F.first(segment).alias(segment), F.count("*").alias("n"))


def merge_parallel(compressed: DataFrame) -> DataFrame:
    """(src, dst, chains array): parallel compressed edges as one."""
    return compressed.groupBy("src", "dst").agg(F.array_sort(F.collect_list("chain")).alias("chains"))


def compressed_view(compressed: DataFrame) -> DataFrame:
    """Parallel edges merged, then chains of these joined: (chain, src, dst, path) with path an array of arrays of chains.

    Reverse bubbles, sets of edges that lead back along another set, are left out.
    """
    merged = merge_parallel(compressed)
    back = merged.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    merged = merged.join(back, ["src", "dst"], "left_anti").withColumn("eid", F.col("chains")[0])
    chains = linear_chains(merged.select("eid", "src", "dst"))
    return merged.join(chains, "eid").groupBy("chain").agg(
        F.min_by("src", "position").alias("src"), F.max_by("dst", "position").alias("dst"), F.transform(F.array_sort(F.collect_list(F.struct("position", "chains"))), lambda x: x["chains"]).alias("path")
    )


def key_segments(compressed: DataFrame) -> DataFrame:
    """(chain, is_key): edges whose source has fewer than two in-edges and target fewer than two out-edges."""
    d = degrees(compressed)
    joined = compressed.join(d.select(F.col("node").alias("src"), F.col("in_degree").alias("i")), "src").join(d.select(F.col("node").alias("dst"), F.col("out_degree").alias("o")), "dst")
    return joined.select("chain", ((F.col("i") < 2) & (F.col("o") < 2)).alias("is_key"))


def subset_graph(sets: DataFrame, owner: str, member: str) -> DataFrame:
    """(larger, smaller): a set holds all members of another and more.

    A set is looked up by its rarest member alone, among the sets that hold it. Of those, 64 bits drawn from the members leave few that the
    members themselves must be compared with. A null is a member that equals no other.
    """
    distinct = materialize(sets.select(F.col(owner).alias("owner"), F.col(member).alias("member")).where("owner is not null").distinct(), "sets")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(member), 64) as int))")
    whole = materialize(distinct.groupBy("owner").agg(F.count("*").alias("size"), F.bit_or(bit).alias("bits"), F.sort_array(F.collect_set("member")).alias("members")), "whole")
    held = whole.select("owner", "size", "bits", F.explode("members").alias("member"))
    rarity = distinct.groupBy("member").agg(F.count("*").alias("n"))
    full = held.join(rarity, "member").groupBy("owner").agg(F.min(F.struct("n", "member")).alias("rarest"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.count("*").alias("known")).where("known = size")
    probes = full.select(F.col("owner").alias("smaller"), F.col("size").alias("ss"), F.col("bits").alias("sb"), F.col("rarest.member").alias("member"))
    index = held.select(F.col("owner").alias("larger"), F.col("size").alias("ls"), F.col("bits").alias("lb"), "member")
    met = probes.join(index, "member").where((F.col("ss") < F.col("ls")) & (F.col("sb").bitwiseAND(F.col("lb")) == F.col("sb"))).select("larger", "smaller", "ss")
    one = met.where("ss = 1").select("larger", "smaller")  # its only member was looked up
    rest = met.where("ss > 1").join(whole.select(F.col("owner").alias("larger"), F.col("members").alias("x")), "larger").join(whole.select(F.col("owner").alias("smaller"), F.col("members").alias("y")), "smaller")
    return one.unionByName(rest.where(F.size(F.array_except("y", "x")) == 0).select("larger", "smaller"))


# ---- Small graphs, inside one task (B18) -----------------------------------------------------------


def reduce_dag(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges of a DAG that no longer path replaces."""
    out: dict = defaultdict(set)
    for s, t in edges:
        out[s].add(t)

    def reaches(a: int, b: int, skip: tuple[int, int]) -> bool:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for y in out[x]:
                if (x, y) == skip or y in seen:
                    continue
                if y == b:
                    return True
                seen.add(y)
                todo.append(y)
        return False

    return [e for e in dict.fromkeys(edges) if not reaches(e[0], e[1], e)]


def self_avoiding_paths(edges: list[tuple[int, int]], start: int, stop: int, most: int = 1000) -> list[list[int]]:
    """All paths without repeated nodes, in order of their nodes, at most `most`."""
    out: dict = defaultdict(list)
    for s, t in sorted(set(edges)):
        out[s].append(t)
    found, todo = [], [[start]]
    while todo and len(found) < most:
        path = todo.pop()
        if path[-1] == stop:
            found.append(path)
            continue
        todo += [[*path, y] for y in reversed(out[path[-1]]) if y not in path]
    return found


def approximate_topological_sort(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Ranks of nodes: edges (src, dst, weight) enter a DAG by descending weight where they close no circle; the rest is ignored."""
    out: dict = defaultdict(set)

    def reaches(a: int, b: int) -> bool:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            for y in out[x] - seen:
                seen.add(y)
                todo.append(y)
        return False

    degree: dict = {}
    for s, t, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        degree.setdefault(s, 0)
        degree.setdefault(t, 0)
        if s != t and t not in out[s] and not reaches(t, s):
            out[s].add(t)
            degree[t] += 1
    heap = [x for x, d in degree.items() if not d]
    heapq.heapify(heap)
    rank: dict[int, int] = {}
    while heap:
        x = heapq.heappop(heap)
        rank[x] = len(rank)
        for y in out[x]:
            degree[y] -= 1
            if not degree[y]:
                heapq.heappush(heap, y)
    return rank


def dominator_tree(edges: list[tuple[int, int]], root: int) -> dict[int, int]:
    """Immediate dominators of all nodes that the root reaches."""
    out, into = defaultdict(list), defaultdict(list)
    for s, t in edges:
        out[s].append(t)
        into[t].append(s)
    order, seen, todo = [], {root}, [(root, iter(sorted(out[root])))]
    while todo:
        x, it = todo[-1]
        for y in it:
            if y not in seen:
                seen.add(y)
                todo.append((y, iter(sorted(out[y]))))
                break
        else:
            order.append(x)
            todo.pop()
    number = {x: i for i, x in enumerate(order)}
    up = {root: root}
    changed = True
    while changed:
        changed = False
        for x in reversed(order[:-1]):
            new = None
            for p in into[x]:
                if p not in up:
                    continue
                if new is None:
                    new = p
                    continue
                a, b = p, new
                while a != b:
                    while number[a] < number[b]:
                        a = up[a]
                    while number[b] < number[a]:
                        b = up[b]
                new = a
            if up.get(x) != new:
                up[x], changed = new, True
    del up[root]
    return up
