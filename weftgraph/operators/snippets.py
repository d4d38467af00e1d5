"""Clusters of journey snippets by containment of their segment sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.graph import strong_components
from weftgraph.storage import discard, materialize


#: Bits of a long.
BITS = 64


def journey_snippets(journeys: DataFrame, subgraphs: DataFrame, *, owner: str = "owner", segment: str = "segment") -> DataFrame:
    """(subgraph, owner, first, last, segments, members): maximal runs of each journey (owner, idx, segment) inside each subgraph (subgraph, segment).

    segments holds what the run visits, in order, members the same as a sorted set.
    """
    inside = journeys.select(F.col(owner).alias("owner"), "idx", F.col(segment).alias("segment")).join(subgraphs.select("subgraph", F.col(segment).alias("segment")).distinct(), "segment")
    by = Window.partitionBy("subgraph", "owner").orderBy("idx")
    runs = inside.withColumn("run", F.col("idx") - F.row_number().over(by))
    gathered = runs.groupBy("subgraph", "owner", "run").agg(F.array_sort(F.collect_list(F.struct("idx", "segment"))).alias("v"))
    visits = F.transform("v", lambda x: x["segment"])
    return gathered.select("subgraph", "owner", F.col("v")[0]["idx"].alias("first"), F.element_at("v", -1)["idx"].alias("last"), visits.alias("segments"), F.array_sort(F.array_distinct(visits)).alias("members"))


def containment(sets: DataFrame, fraction: float = 0.05) -> DataFrame:
    """(larger, smaller) of sets (id, subgraph, members) of which the larger holds all but round(fraction * size) members of the smaller.

    A set that holds all but t members of another holds at least one of any t + 1 of them: the t + 1 rarest are looked up, so
    a member that all sets share is looked up only by sets that have no rarer ones. A set's members are also bits of a long, so that pairs
    of which too much is missing go where they are met, before they are shuffled.
    """
    sized = sets.select("id", "subgraph", "members", F.size("members").alias("size"), F.round(F.lit(fraction) * F.size("members")).cast("int").alias("spare"))
    member = materialize(sized.select("id", "subgraph", "size", "spare", F.explode("members").alias("member")), "members")
    rarity = member.groupBy("subgraph", "member").agg(F.count("*").alias("n"))
    # each member of a subgraph has a bit; beyond BITS members share bits, and what passes by bits is then held against the members
    place = F.row_number().over(Window.partitionBy("subgraph").orderBy("n", "member")) - 1
    rarity = materialize(rarity.withColumns({"bit": place, "few": F.count("*").over(Window.partitionBy("subgraph")) <= BITS}), "members")
    bits = member.join(rarity, ["subgraph", "member"]).groupBy("id").agg(F.bit_or(F.expr(f"shiftleft(1L, bit % {BITS})")).alias("bits"))
    member = materialize(member.join(rarity, ["subgraph", "member"]).join(bits, "id"), "members")
    by = Window.partitionBy("id").orderBy("n", "member")
    probes = member.withColumn("k", F.row_number().over(by)).where(F.col("k") <= F.col("spare") + 1)
    probes = probes.select("subgraph", "member", F.col("id").alias("smaller"), (F.col("size") - F.col("spare")).alias("least"), "spare", F.col("bits").alias("y"), "few")
    held = probes.join(member.select("subgraph", "member", F.col("id").alias("larger"), "size", F.col("bits").alias("x")), ["subgraph", "member"])
    held = held.where("larger != smaller and size >= least and bit_count(y & ~x) <= spare")
    # a set without spare members has one probe, so meets each other set once
    met = held.where("spare = 0").select("larger", "smaller", "least", "few").unionByName(held.where("spare > 0").select("larger", "smaller", "least", "few").distinct())
    met = materialize(met, "met")
    own = sized.select("id", "members")
    crowded = met.where("not few").join(own.select(F.col("id").alias("larger"), F.col("members").alias("x")), "larger").join(own.select(F.col("id").alias("smaller"), F.col("members").alias("y")), "smaller")
    crowded = crowded.where(F.size(F.array_intersect("x", "y")) >= F.col("least"))
    return met.where("few").select("larger", "smaller").unionByName(crowded.select("larger", "smaller"))


def snippet_clusters(snippets: DataFrame, *, fraction: float = 0.05, least_snippets: int = 6) -> DataFrame:
    """(subgraph, top, owner, first, segments): the snippets of every cluster; `top` names the cluster by the members of its largest set, ties to the least.

    Sets of snippets hold each other up to `fraction` of their members; sets that hold each other both ways, directly or not, count as one.
    A set that none holds is the head of a cluster, to which the sets belong that are held, at any depth, under this head only. Clusters of fewer than
    least_snippets snippets are left out. cluster_segments() gives the clusters' segments.
    """
    snippets = materialize(snippets, "snippets")
    sets = materialize(snippets.groupBy("subgraph", "members").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "sets")
    held = materialize(containment(sets, fraction), "held")
    sizes = sets.select("id", F.size("members").alias("size"))
    # only sets that may lack a member of one they are held by can be part of a circle
    smallest = sizes.where(F.round(F.lit(fraction) * F.col("size")) >= 1).agg(F.min(F.col("size") - F.round(F.lit(fraction) * F.col("size")))).first()[0]
    if smallest is None:
        head_of = sets.select("id", F.col("id").alias("part"))
    else:
        big = sizes.where(F.col("size") >= smallest).select("id")
        may = held.join(big.withColumnRenamed("id", "larger"), "larger", "left_semi").join(big.withColumnRenamed("id", "smaller"), "smaller", "left_semi")
        circles = strong_components(may, "larger", "smaller")
        head_of = sets.select("id").join(circles, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("part"))
    head_of = materialize(head_of, "parts")
    a, b = head_of.select(F.col("id").alias("larger"), F.col("part").alias("u")), head_of.select(F.col("id").alias("smaller"), F.col("part").alias("v"))
    edges = materialize(held.join(a, "larger").join(b, "smaller").where("u != v").select("u", "v").distinct(), "held")
    # the least and the greatest head above each part: one head only if they are the same
    heads = head_of.select("part").distinct().join(edges.select(F.col("v").alias("part")).distinct(), "part", "left_anti").select("part", F.col("part").alias("low"), F.col("part").alias("high"))
    known = materialize(heads, "heads")
    before = None
    while True:
        down = edges.join(known.withColumnRenamed("part", "u"), "u").select(F.col("v").alias("part"), "low", "high")
        old, known = known, materialize(known.unionByName(down).groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")), "heads")
        discard(old)
        now = known.agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.col("high").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    single = head_of.join(known.where("low = high").select("part", F.col("low").alias("head")), "part").select("id", "head")
    names = sets.join(head_of, "id").groupBy(F.col("part").alias("head")).agg(F.min(F.struct((-F.size("members")).alias("size"), "members")).getField("members").alias("top"))
    joined = snippets.join(sets.select("subgraph", "members", "id"), ["subgraph", "members"]).join(single, "id").join(names, "head")
    enough = joined.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") >= least_snippets).select("head")
    return joined.join(enough, "head", "left_semi").select("subgraph", "top", "owner", "first", "segments")


def cluster_segments(clusters: DataFrame, least_coverage: int = 6) -> DataFrame:
    """(subgraph, top, segment, coverage): the visits of each cluster's snippets to each segment, least_coverage at least."""
    visits = clusters.select("subgraph", "top", F.explode("segments").alias("segment"))
    return visits.groupBy("subgraph", "top", "segment").agg(F.count("*").alias("coverage")).where(F.col("coverage") >= least_coverage)
