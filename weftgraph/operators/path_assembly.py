"""Sequence of assembly paths: segments joined by the consensus of the reads that cross their links."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.consensus import BASES, multiple_alignment
from weftgraph.shipping import ship
from weftgraph.storage import discard, materialize


def weighted_consensus(counted: dict[str, int]) -> str:
    """The majority of each column of the multiple alignment of distinct sequences, each as often as it was seen; ties to the first of BASES, without gaps.

    Sequences are aligned by descending count, then in order. Characters that BASES doesn't know come last in a tie, in order.
    """
    order = sorted(counted, key=lambda s: (-counted[s], s))
    rows = multiple_alignment(order) if len(order) > 1 else order
    out = []
    for column in zip(*rows, strict=True):
        votes: Counter = Counter()
        for c, s in zip(column, order, strict=True):
            votes[c] += counted[s]
        best = min(votes, key=lambda c: (-votes[c], BASES.find(c) % (len(BASES) + 1), c))
        if best != "-":
            out.append(best)
    return "".join(out)


def path_links(paths: DataFrame) -> DataFrame:
    """(start, idx, s0, s1, before, behind): the links of paths (start, idx, segment, is_primary), with the last primary segment up to them and the first one after."""
    by = Window.partitionBy("start").orderBy("idx")
    primary = F.when(F.col("is_primary"), F.col("segment"))
    ahead = by.rowsBetween(1, Window.unboundedFollowing)
    rows = paths.select(
        "start", "idx", F.col("segment").alias("s0"), F.lead("segment").over(by).alias("s1"), F.last(primary, True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("before"), F.first(primary, True).over(ahead).alias("behind"),
    )
    return rows.where("s1 is not null")


def link_consensus(links: DataFrame, segments: DataFrame, crossings: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(start, idx, coverage, sequence, left, right, cut0, cut1): what each link of path_links() adds between its segments.

    segments has (segment, sequence, offsets): where each of its markers, k bases long, begins in its sequence. crossings has
    (owner, s0, s1, p0, p1, sequence): the last marker of s0 and the first of s1 that an owner meets, and its own bases from the first through the second.
    Only owners that members (segment, owner) has on the primary segment before or behind the link count. Each owner's bases are
    filled up with those of the segments to a common start and end; the consensus of all, where it equals the segments at its ends,
    is trimmed (left, right), and the segments are cut (cut0 bases at the end of s0, cut1 at the start of s1) where it takes over. Equal stretches are counted
    before they are aligned: a group holds a link's distinct ones, which the coverage bound of vertices keeps few.
    """
    ship(links.sparkSession)
    seen = members.select(F.col("segment").alias("at"), "owner").distinct()
    crossed = links.join(crossings.withColumnRenamed("sequence", "bases"), ["s0", "s1"])
    used = crossed.withColumn("at", F.explode(F.array_distinct(F.array_compact(F.array("before", "behind"))))).join(seen, ["at", "owner"], "left_semi").drop("at").distinct()
    used = materialize(used, "crossings")
    bounds = used.groupBy("start", "idx").agg(F.min("p0").alias("low"), F.max("p1").alias("high"))
    a = segments.select(F.col("segment").alias("s0"), F.col("sequence").alias("q0"), F.col("offsets").alias("o0"))
    b = segments.select(F.col("segment").alias("s1"), F.col("sequence").alias("q1"), F.col("offsets").alias("o1"))
    rows = used.join(bounds, ["start", "idx"]).join(a, "s0").join(b, "s1")
    at = lambda o, p: F.get(o, p)
    piece = lambda q, first, last: F.substring(q, first + 1, last - first)
    whole = F.concat(piece("q0", at("o0", "low"), at("o0", "p0")), "bases", piece("q1", at("o1", "p1") + k, at("o1", "high") + k))
    told = rows.select("start", "idx", whole.alias("whole"), piece("q0", at("o0", "low"), F.length("q0")).alias("tail"), piece("q1", F.lit(0), at("o1", "high") + k).alias("head"))
    counted = told.groupBy("start", "idx", "whole").agg(F.count("*").alias("n"), F.first("tail").alias("tail"), F.first("head").alias("head"))
    kind = links.schema["start"].dataType.simpleString()

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        found = weighted_consensus(dict(zip(pdf["whole"], pdf["n"], strict=True)))
        tail, head = pdf["tail"].iloc[0], pdf["head"].iloc[0]
        left = 0
        while left < min(len(found), len(tail)) and found[left] == tail[left]:
            left += 1
        right = 0
        while right < min(len(found) - left, len(head)) and found[-1 - right] == head[-1 - right]:
            right += 1
        row = {"start": pdf["start"].iloc[0], "idx": pdf["idx"].iloc[0], "coverage": int(pdf["n"].sum()), "sequence": found, "left": left, "right": right, "cut0": len(tail) - left, "cut1": len(head) - right}
        return pd.DataFrame([row])

    out = counted.groupBy("start", "idx").applyInPandas(call, f"start {kind}, idx long, coverage long, sequence string, left int, right int, cut0 int, cut1 int")
    return out


def assemble_paths(paths: DataFrame, segments: DataFrame, crossings: DataFrame, members: DataFrame, k: int, adjacent: DataFrame | None = None) -> DataFrame:
    """(start, sequence): the sequence along each path of walks.assembly_paths().

    Segments that `adjacent` (s0, s1) lists share a marker: each gives up half of it. Between others stands the consensus of their link; without an owner that counts,
    the segments follow each other uncut. A segment that its two links would cut beyond its length adds nothing.
    """
    links = materialize(path_links(paths), "links")
    near = None if adjacent is None else adjacent.select("s0", "s1").distinct()
    far = links if near is None else links.join(near, ["s0", "s1"], "left_anti")
    called = materialize(link_consensus(far, segments, crossings, members, k), "consensus")
    cuts = called.select("start", "idx", "cut0", "cut1")
    if near is not None:
        cuts = cuts.unionByName(links.join(near, ["s0", "s1"]).select("start", "idx", F.lit(k // 2).alias("cut0"), F.lit(k - k // 2).alias("cut1")))
    cuts = materialize(cuts, "cuts")
    placed = paths.select("start", "idx", "segment").join(segments.select("segment", "sequence"), "segment")
    placed = placed.join(cuts.select("start", "idx", F.col("cut0").alias("end")), ["start", "idx"], "left").join(cuts.select("start", (F.col("idx") + 1).alias("idx"), F.col("cut1").alias("begin")), ["start", "idx"], "left")
    begin, end = F.coalesce("begin", F.lit(0)), F.coalesce("end", F.lit(0))
    bodies = placed.select("start", "idx", F.lit(0).alias("kind"), F.substring("sequence", begin + 1, F.greatest(F.length("sequence") - begin - end, F.lit(0))).alias("piece"))
    between = called.select("start", "idx", F.lit(1).alias("kind"), F.substring("sequence", F.col("left") + 1, F.length("sequence") - F.col("left") - F.col("right")).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "kind", "piece")))
    told = bodies.unionByName(between).groupBy("start").agg(ordered.alias("v")).select("start", F.array_join(F.transform("v", lambda x: x["piece"]), "").alias("sequence"))
    out = materialize(told, "assembled")
    discard(links, called, cuts)
    return out
