"""Journeys through segments, links and segment similarity (M1-M22; the walks M12, M13 and M16 are in walks.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.assembly_graph import edge_table
from weftgraph.operators.graph import connected_components
from weftgraph.operators.read_graph import within_hops
from weftgraph.storage import materialize, small_enough


def marker_journeys(compressed: DataFrame, intervals: DataFrame) -> DataFrame:
    """M2, M3: (owner, ordinal, segment, position): which segment each read meets at each of its ordinals; intervals (eid, owner, ordinal)."""
    return intervals.join(edge_table(compressed), "eid").select("owner", "ordinal", F.col("chain").alias("segment"), "position")


def segment_journeys(visits: DataFrame, owner: str, order: list[str], segment: str) -> DataFrame:
    """M4: (owner, idx, segment, first, last): each owner's runs of equal segments, with the first and last order values of each run."""
    by = Window.partitionBy(owner).orderBy(*order)
    opens = visits.withColumn("open", F.coalesce(F.col(segment) != F.lag(segment).over(by), F.lit(True)).cast("int"))
    runs = opens.withColumn("idx", F.sum("open").over(by) - 1)
    key = F.struct(*order)
    return runs.groupBy(owner, "idx").agg(F.min_by(segment, key).alias(segment), F.min(key).getField(order[0]).alias("first"), F.max(key).getField(order[0]).alias("last"))


def journeys_by_segment(journeys: DataFrame, owner: str, segment: str) -> DataFrame:
    """M5: the owners that visit each segment, with their places, in order."""
    return journeys.groupBy(segment).agg(F.array_sort(F.collect_list(F.struct(owner, "idx"))).alias("visits"))


def transitions(journeys: DataFrame, owner: str, segment: str) -> DataFrame:
    """M6: (owner, s0, s1, last0, first1): consecutive segments of each journey."""
    by = Window.partitionBy(owner).orderBy("idx")
    steps = journeys.select(owner, F.col(segment).alias("s0"), F.lead(segment).over(by).alias("s1"), F.col("last").alias("last0"), F.lead("first").over(by).alias("first1"))
    return steps.where("s1 is not null")


def links(steps: DataFrame, least: int = 3, separation: str | None = None) -> DataFrame:
    """M7: (s0, s1, coverage, separation) of segment pairs with at least `least` transitions; separation is the rounded mean of that column."""
    value = F.round(F.avg(separation)).cast("long") if separation else F.lit(None).cast("long")
    return steps.groupBy("s0", "s1").agg(F.count("*").alias("coverage"), value.alias("separation")).where(F.col("coverage") >= least)


def back_segments(found: DataFrame) -> DataFrame:
    """M8: (segment): segments with one link in and one out, both with the same segment."""
    out = found.groupBy(F.col("s0").alias("segment")).agg(F.count("*").alias("n_out"), F.min("s1").alias("to"))
    in_ = found.groupBy(F.col("s1").alias("segment")).agg(F.count("*").alias("n_in"), F.min("s0").alias("from"))
    return out.join(in_, "segment").where("n_out = 1 and n_in = 1 and `to` = `from`").select("segment")


def segment_members(visits: DataFrame, owner: str, segment: str, offset: str) -> DataFrame:
    """M9: (segment, owner, n, offset): each owner on a segment with its mean offset, rounded."""
    return visits.groupBy(segment, owner).agg(F.count("*").alias("n"), F.round(F.avg(offset)).cast("long").alias("offset"))


def pair_offsets(members: DataFrame, owner: str, segment: str) -> DataFrame:
    """(a, b, common, offset): for segments with common owners, how many and the rounded mean difference of their offsets."""
    a = members.select(F.col(segment).alias("a"), owner, F.col("offset").alias("oa"))
    b = members.select(F.col(segment).alias("b"), owner, F.col("offset").alias("ob"))
    return a.join(b, owner).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"), F.round(F.avg(F.col("ob") - F.col("oa"))).cast("long").alias("offset"))


def segment_pairs(members: DataFrame, spans: DataFrame, lengths: DataFrame, owner: str = "owner", segment: str = "segment") -> DataFrame:
    """(a, b, common, unexplained_a, unexplained_b, short_a, short_b, jaccard, raw_jaccard) of segment pairs with common owners.

    An owner of one segment but not of the other is "short" if, at the pair's estimated offset, its span wouldn't reach the
    other segment, else "unexplained". spans has (owner, first, last) of each owner, lengths (segment, length), 1 at least.

    The owners of one segment alone are those of the segment less the common ones. Of a segment's owners those that reach are counted for all
    its pairs in one sorted pass, so rows are owners and pairs, never each pair's owners.
    """
    offsets = materialize(pair_offsets(members, owner, segment), "pairs")
    longs = lambda x: lengths.select(F.col(segment).alias(x), F.col("length").alias(f"length_{x}"))
    placed = materialize(offsets.join(longs("a"), "a", "left").join(longs("b"), "b", "left"), "pairs")
    here = materialize(members.select(segment, owner, F.col("offset").alias("at")).join(spans.select(owner, "first", "last"), owner, "left"), "pairs")
    known = F.col("at").isNotNull() & F.col("first").isNotNull() & F.col("last").isNotNull()

    def reached(at: str, offset: Column, length: str) -> Column:
        return (F.col(at) + offset < F.col("last")) & (F.col(at) + offset + F.col(length) > F.col("first"))

    x, y = here.select(F.col(segment).alias("a"), owner, F.col("at").alias("at_a"), "first", "last"), here.select(F.col(segment).alias("b"), owner, F.col("at").alias("at_b"))
    spanned = F.col("first").isNotNull() & F.col("last").isNotNull()
    both = x.join(y, owner).where("a < b").join(small_enough(placed.select("a", "b", "offset", "length_a", "length_b"), 64), ["a", "b"])
    shared = both.groupBy("a", "b").agg(
        F.count_if(spanned & F.col("at_a").isNotNull()).alias("shared_a"), F.count_if(reached("at_a", F.col("offset"), "length_b")).alias("both_a"),
        F.count_if(spanned & F.col("at_b").isNotNull()).alias("shared_b"), F.count_if(reached("at_b", -F.col("offset"), "length_a")).alias("both_b"),
    )

    # an owner reaches from below its span's end, unless from before its beginning: two counts of values above a bound
    ends = here.where(known).select(segment, F.explode(F.array(F.struct(F.lit("last").alias("end"), (F.col("last") - F.col("at")).alias("v")), F.struct(F.lit("first").alias("end"), (F.col("first") - F.col("at")).alias("v")))).alias("e"))
    none = F.lit(None).cast(dict(offsets.dtypes)["a"])
    rows = ends.groupBy(segment, "e.end", "e.v").agg(F.count("*").alias("n")).select(segment, "end", "v", (F.col("end") == "last").cast("int").alias("turn"), "n", none.alias("a"), none.alias("b"))
    for side, there, sign in (("a", "b", 1), ("b", "a", -1)):
        bound = sign * F.col("offset")
        ask = F.array(F.struct(F.lit("last").alias("end"), bound.alias("v")), F.struct(F.lit("first").alias("end"), (bound + F.col(f"length_{there}")).alias("v")))
        asked = placed.where(f"offset is not null and length_{there} is not null").select(F.col(side).alias(segment), F.explode(ask).alias("e"), "a", "b")
        rows = rows.unionByName(asked.select(segment, "e.end", "e.v", (F.col("end") == "first").cast("int").alias("turn"), F.lit(0).cast("long").alias("n"), "a", "b"))
    above = Window.partitionBy(segment, "end").orderBy(F.desc("v"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("n", F.sum("n").over(above) * F.when(F.col("end") == "last", 1).otherwise(-1)).where("a is not null")
    total = here.where(known).groupBy(segment).agg(F.count("*").alias("total"))
    all_ = counted.groupBy("a", "b", segment).agg(F.sum("n").alias("all")).join(total, segment, "left")

    def side(x: str) -> DataFrame:
        return all_.where(F.col(segment) == F.col(x)).select("a", "b", F.coalesce("all", F.lit(0)).alias(f"all_{x}"), F.coalesce("total", F.lit(0)).alias(f"total_{x}"))

    joined = placed.join(shared, ["a", "b"]).join(side("a"), ["a", "b"], "left").join(side("b"), ["a", "b"], "left")
    for x in ("a", "b"):
        alone, reach = F.col(f"total_{x}") - F.col(f"shared_{x}"), F.col(f"all_{x}") - F.col(f"both_{x}")
        joined = joined.withColumns({f"unexplained_{x}": F.coalesce(reach, F.lit(0)), f"short_{x}": F.coalesce(alone - reach, F.lit(0))})
    c, ua, ub, sa, sb = (F.col(x) for x in ("common", "unexplained_a", "unexplained_b", "short_a", "short_b"))
    return joined.select("a", "b", "common", *(F.col(x).cast("long").alias(x) for x in ("unexplained_a", "unexplained_b", "short_a", "short_b")), F.round(c / (c + ua + ub), 6).alias("jaccard"), F.round(c / (c + ua + ub + sa + sb), 6).alias("raw_jaccard"))


def strong_only(graph: DataFrame) -> DataFrame:
    """Edges between segments that strong edges join to something."""
    strong = graph.where("forward and backward")
    nodes = strong.select(F.explode(F.array("s0", "s1")).alias("s")).distinct()
    return graph.join(nodes.withColumnRenamed("s", "s0"), "s0", "left_semi").join(nodes.withColumnRenamed("s", "s1"), "s1", "left_semi").select(graph.columns)


def clusters(graph: DataFrame, least: int = 5) -> DataFrame:
    """(node, component) of components of at least `least` segments."""
    parts = connected_components(graph, "s0", "s1")
    big = parts.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return parts.join(big.select("component"), "component", "left_semi").select("node", "component")


def similar_segments(pairs: DataFrame, found_links: DataFrame, starts: DataFrame, hops: int, least_jaccard: float) -> DataFrame:
    """(start, node, distance, raw_jaccard): segments within `hops` links of each start that are similar to it."""
    near = within_hops(starts, found_links.select(F.col("s0").alias("u"), F.col("s1").alias("v")), hops).where("distance > 0")
    sym = pairs.select(F.col("a").alias("start"), F.col("b").alias("node"), "raw_jaccard").unionByName(pairs.select(F.col("b").alias("start"), F.col("a").alias("node"), "raw_jaccard"))
    return near.join(sym, ["start", "node"]).where(F.col("raw_jaccard") >= least_jaccard)


def path_graph(journeys: DataFrame, owner: str, segment: str, least: int = 3) -> DataFrame:
    """Edges (u, v, coverage) between consecutive segments of journeys, by at least `least` owners."""
    by = Window.partitionBy(owner).orderBy("idx")
    steps = journeys.select(owner, F.col(segment).alias("u"), F.lead(segment).over(by).alias("v")).where("v is not null")
    return steps.groupBy("u", "v").agg(F.countDistinct(owner).alias("coverage")).where(F.col("coverage") >= least)


def partition_by_distance(edges: DataFrame, distance: int = 10, least: int = 8) -> DataFrame:
    """(node, part): nodes go to the least start within `distance` steps, starts being local minima; parts of fewer than `least` are left out."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    near = within_hops(nodes, edges, distance)
    best = near.groupBy("node").agg(F.min("start").alias("part"))
    sizes = best.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return best.join(sizes.select("part"), "part", "left_semi").select("node", "part")
