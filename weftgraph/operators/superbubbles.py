"""Superbubbles with one way in and one way out, taken apart at their choke points."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.assembly_graph import dominator_tree
from weftgraph.operators.graph import connected_components
from weftgraph.shipping import ship
from weftgraph.storage import discard, materialize

_PLAN = "component long, chunk int, kind string, src long, dst long, eids array<long>"


def _first_choke(node: int, up: dict[int, int], place: dict[int, int]) -> int | None:
    """The place on the critical path of the first choke point from `node` up a dominator tree."""
    while node not in place:
        if node not in up:
            return None
        node = up[node]
    return place[node]


def edge_paths(edges: list[tuple[int, int, int]], start: int, stop: int, most: int) -> list[list[int]]:
    """Paths of edges (eid, src, dst) without repeated nodes, in order of their edge ids; one more than `most` at most."""
    out: dict = defaultdict(list)
    for eid, s, t in sorted(edges):
        out[s].append((eid, t))
    found: list[list[int]] = []

    def go(node: int, path: list[int], seen: set[int]) -> None:
        if node == stop:
            found.append(list(path))
            return
        for eid, t in out[node]:
            if len(found) > most:
                return
            if t not in seen:
                path.append(eid)
                seen.add(t)
                go(t, path, seen)
                seen.discard(t)
                path.pop()

    go(start, [], {start})
    return found


def choke_points(edges: list[tuple[int, int]], start: int, stop: int) -> tuple[list[int], dict[tuple[int, int], int]]:
    """The nodes that every way from start to stop takes, in order, and between which of them each edge lies.

    An edge belongs to chunk i if the choke point that dominates its source is the i-th and the one that its target
    can't miss is the next; edges of no chunk lie on no way. Without any way both are empty.
    """
    down = dominator_tree(edges, start)
    back = dominator_tree([(t, s) for s, t in edges], stop)
    if stop not in down or start not in back:
        return [], {}
    path = [stop]
    while path[-1] != start:
        path.append(down[path[-1]])
    path.reverse()
    place = {x: i for i, x in enumerate(path)}
    chunk = {}
    for s, t in edges:
        i, j = _first_choke(s, down, place), _first_choke(t, back, place)
        if i is not None and j == i + 1:
            chunk[s, t] = i
    return path, chunk


def _take_apart(start: int, stop: int, info: dict[int, tuple[int, int, float, float]], chunk_edges: int, chunk_paths: int) -> list[tuple]:
    """What becomes of one superbubble of edges eid: (src, dst, coverage, length): rows (chunk, kind, src, dst, eids)."""
    pairs = sorted({x[:2] for x in info.values()})
    path, chunk_of = choke_points(pairs, start, stop)
    if not path:
        return [(-1, "no way through", start, stop, [])]
    rows = [(-1, "unreachable", s, t, []) for s, t in pairs if (s, t) not in chunk_of]
    chunks: dict = defaultdict(list)
    for e, (s, t, _, _) in info.items():
        chunks[chunk_of.get((s, t))].append((e, s, t))
    for i, (here, there) in enumerate(zip(path, path[1:])):
        inside = chunks[i]
        if all(t == there for _, s, t in inside if s == here):
            continue
        if len(inside) > chunk_edges:
            rows.append((i, "too many edges", here, there, []))
            continue
        ways = edge_paths(inside, here, there, chunk_paths)
        if len(ways) > chunk_paths:
            rows.append((i, "too many paths", here, there, []))
            continue

        def mean(way: list[int]) -> float:
            return sum(info[e][2] * info[e][3] for e in way) / max(sum(info[e][3] for e in way), 1e-9)

        best = sorted(ways, key=lambda w: -mean(w))[:2]
        rows.append((i, "replaced", here, there, [e for e, _, _ in inside]))
        if len(best) == 1:
            rows.append((i, "single", here, there, best[0]))
            continue
        a, b = best
        head = 0
        while a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        parts = [("single", a[:head]), ("branch", a[head : len(a) - tail]), ("branch", b[head : len(b) - tail]), ("single", a[len(a) - tail :])]
        rows += [(i, kind, info[x[0]][0], info[x[-1]][1], x) for kind, x in parts if x]
    return rows


def superbubbles(edges: DataFrame, *, inner: str = "inner", most_nodes: int = 50, parts: DataFrame | None = None) -> DataFrame:
    """(component, nodes, start, stop, verdict) of every component of inner edges that isn't a single chain of edges.

    edges has (eid, src, dst, `inner`), each eid once. An entrance has an edge from outside and one to the inside, an exit the reverse; the verdict is "ready" with
    one of each and at most most_nodes nodes, else the reason why the superbubble is left as it is. `parts` are the
    components (node, component) of the inner edges, if known.
    """
    if parts is None:
        parts = materialize(connected_components(edges.where(F.col(inner)), "src", "dst"), "superbubbles")
    side = lambda x, name: parts.select(F.col("node").alias(x), F.col("component").alias(name))
    placed = edges.where("src != dst").join(side("src", "cs"), "src", "left").join(side("dst", "cd"), "dst", "left").select("src", "dst", "cs", "cd")
    inside = F.col("cs").eqNullSafe(F.col("cd"))
    none = F.lit(False)

    def end(node: str, component: str, out_in, out_ex, in_in, in_ex):
        return F.struct(F.col(node).alias("node"), F.col(component).alias("component"), out_in.alias("out_in"), out_ex.alias("out_ex"), in_in.alias("in_in"), in_ex.alias("in_ex"))

    both = F.array(end("src", "cs", inside, ~inside, none, none), end("dst", "cd", none, none, inside, ~inside))
    ends = placed.select(F.explode(both).alias("e")).select("e.*").where("component is not null")
    nodes = ends.groupBy("component", "node").agg(*(F.bool_or(x).alias(x) for x in ("out_in", "out_ex", "in_in", "in_ex")), F.count_if("out_in").alias("n_out"), F.count_if("in_in").alias("n_in"))
    entrance, exit_ = F.col("in_ex") & F.col("out_in"), F.col("in_in") & F.col("out_ex")
    found = nodes.groupBy("component").agg(
        F.count("*").alias("nodes"), F.count_if(entrance).alias("entrances"), F.count_if(exit_).alias("exits"), F.min(F.when(entrance, F.col("node"))).alias("start"),
        F.min(F.when(exit_, F.col("node"))).alias("stop"), (F.max("n_out") <= 1).alias("thin_out"), (F.max("n_in") <= 1).alias("thin_in"),
    ).where("not (thin_out and thin_in)")
    verdict = F.when((F.col("entrances") != 1) | (F.col("exits") != 1), F.lit("several ways in or out")).when(F.col("nodes") > most_nodes, F.lit("too many nodes")).otherwise(F.lit("ready"))
    return found.select("component", "nodes", "start", "stop", verdict.alias("verdict"))


def superbubble_plans(edges: DataFrame, found: DataFrame, *, inner: str = "inner", chunk_edges: int = 20, chunk_paths: int = 20, parts: DataFrame | None = None) -> DataFrame:
    """What becomes of each ready superbubble of superbubbles(): (component, chunk, kind, src, dst, eids).

    The dominator trees from both ends give the choke points that cut a superbubble into chunks. "unreachable" edges (src, dst) lie on no way
    through. A chunk with a detour is "replaced": its eids go, and its two ways of highest mean coverage, weighted by length, ties to the way that comes first by
    edge ids, come back as a bubble of two "branch" edges between "single" ones that both share. Chunks of more edges or ways stay.

    A group holds at most most_nodes nodes and, of parallel edges, one more than chunk_edges, which already decide that a chunk stays.
    """
    ship(edges.sparkSession)
    ready = found.where("verdict = 'ready'").select("component", "start", "stop")
    members = edges.where(F.col(inner) & (F.col("src") != F.col("dst")))
    kept = members.withColumn("k", F.row_number().over(Window.partitionBy("src", "dst").orderBy("eid"))).where(F.col("k") <= chunk_edges + 1)
    labels = connected_components(members, "src", "dst") if parts is None else parts
    fields = {"eid": "long", "src": "long", "dst": "long", "coverage": "double", "length": "double"}
    rows = kept.join(labels, F.col("src") == F.col("node")).select("component", F.struct(*(F.col(x).cast(kind).alias(x) for x, kind in fields.items())).alias("e"))
    whole = rows.groupBy("component").agg(F.collect_list("e").alias("e")).join(ready, "component").select("component", "start", "stop", *(F.transform("e", lambda e: e[x]).alias(x) for x in fields))  # noqa: B023

    def take(batches):
        for pdf in batches:
            out = []
            for component, start, stop, *lists in zip(*(pdf[x].tolist() for x in pdf.columns), strict=True):
                info = {e: tuple(x) for e, *x in zip(*(x.tolist() for x in lists), strict=True)}
                out += [(component, *x) for x in _take_apart(start, stop, info, chunk_edges, chunk_paths)]
            yield pd.DataFrame(out, columns=["component", "chunk", "kind", "src", "dst", "eids"])

    return whole.mapInPandas(take, _PLAN)


def resolve_superbubbles(edges: DataFrame, *, inner: str = "inner", most_nodes: int = 50, chunk_edges: int = 20, chunk_paths: int = 20) -> DataFrame:
    """(src, dst, kind, path): the edges (eid, src, dst, coverage, length, inner) once every ready superbubble is taken apart.

    An edge that stays is a path of its own, of kind "kept"; new edges are "single" or one of two "branch" edges, their paths the edges they stand for. Self-loops inside a
    superbubble stay. Without a superbubble the edges come back as they are.
    """
    edges = materialize(edges, "superbubbles")
    parts = materialize(connected_components(edges.where(F.col(inner)), "src", "dst"), "superbubbles")
    found = materialize(superbubbles(edges, inner=inner, most_nodes=most_nodes, parts=parts), "superbubbles")
    plans = materialize(superbubble_plans(edges, found, inner=inner, chunk_edges=chunk_edges, chunk_paths=chunk_paths, parts=parts), "superbubbles")
    gone = plans.where("kind = 'replaced'").select(F.explode("eids").alias("eid"))
    dead = plans.where("kind = 'unreachable'").select("src", "dst").withColumn(inner, F.lit(True))
    left = edges.join(gone, "eid", "left_anti").join(dead, ["src", "dst", inner], "left_anti")
    kept = left.select("src", "dst", F.lit("kept").alias("kind"), F.array("eid").alias("path"))
    out = materialize(kept.unionByName(plans.where("kind in ('single', 'branch')").select("src", "dst", "kind", F.col("eids").alias("path"))), "resolved")
    discard(edges, parts, found, plans)
    return out
