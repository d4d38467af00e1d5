"""Walks over links whose every step looks back at a reference segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import discard, materialize


@dataclass(frozen=True)
class WalkOptions:
    """Defaults of the walks: common owners of a link and of a segment with the reference, and what makes two segments alike."""

    least_for_link: int = 3
    least_for_segment: int = 3
    least_jaccard: float = 0.75
    least_separation: int = -20


class _Ground:
    """What every step reads: segments and links by the owners that meet them exactly once, and the segments that are alike."""

    def __init__(self, visits: DataFrame, steps: DataFrame, found_links: DataFrame, pairs: DataFrame, owner: str, segment: str, forward: bool, options: WalkOptions):
        self.least = options.least_for_link
        near, far = ("s0", "s1") if forward else ("s1", "s0")
        usable = found_links.where(F.col("separation").isNull() | (F.col("separation") >= options.least_separation)).select("s0", "s1").distinct()
        once = visits.groupBy(F.col(segment).alias("ref"), F.col(owner).alias("owner")).agg(F.count("*").alias("n")).where("n = 1")
        self.owners = materialize(once.select("ref", "owner"), "walk")
        once = steps.groupBy("s0", "s1", F.col(owner).alias("owner")).agg(F.count("*").alias("n")).where("n = 1").join(usable, ["s0", "s1"], "left_semi")
        self.crossings = materialize(once.select(F.col(near).alias("at"), F.col(far).alias("next"), "owner"), "walk")
        self.ahead = materialize(usable.select(F.col(near).alias("at"), F.col(far).alias("next")), "walk")
        alike = (F.col("common") >= options.least_for_segment) & (F.col("raw_jaccard") >= options.least_jaccard)
        both = pairs.where(alike).select(F.explode(F.array(F.struct(F.col("a").alias("ref"), F.col("b").alias("next")), F.struct(F.col("b").alias("ref"), F.col("a").alias("next")))).alias("p")).select("p.*")
        # a segment is like itself if enough owners meet it
        self_alike = visits.groupBy(F.col(segment).alias("ref")).agg(F.count_distinct(owner).alias("n")).where(F.col("n") >= options.least_for_segment).select("ref", F.col("ref").alias("next"))
        self.alike = materialize(both.unionByName(self_alike).withColumn("alike", F.lit(True)), "walk")

    def step(self, state: DataFrame) -> DataFrame:
        """state (start, ref, at, ...) with `next`, the end of the link from `at` that has most owners in common with `ref` (ties to the least end), and `alike`.

        Walks without such a link end. Each pair of reference and segment is looked up once; an owner of the reference is met with the links that it
        takes itself from the segment, so a round's rows are the references' owners.
        """
        open_ = state.select("ref", "at").distinct()
        counted = open_.join(self.owners, "ref").join(self.crossings, ["at", "owner"]).groupBy("ref", "at", "next").agg(F.count("*").alias("n")).where(F.col("n") >= self.least)
        best = counted.groupBy("ref", "at").agg(F.min_by("next", F.struct((-F.col("n")).alias("n"), "next")).alias("next"))
        return state.join(best, ["ref", "at"]).join(self.alike, ["ref", "next"], "left").withColumn("alike", F.coalesce("alike", F.lit(False)))

    def leave(self) -> None:
        discard(self.owners, self.crossings, self.ahead, self.alike)


def _joined(parts: list[DataFrame], schema: DataFrame, label: str) -> DataFrame:
    out = schema.limit(0)
    for x in parts:
        out = out.unionByName(x)
    return materialize(out, label)


def jaccard_walks(visits: DataFrame, steps: DataFrame, found_links: DataFrame, pairs: DataFrame, *, forward: bool = True, owner: str = "owner", segment: str = "segment", options: WalkOptions = WalkOptions()) -> DataFrame:
    """(s0, s1, segments): from every segment, over the links with most owners in common with that segment, to the first segment like it.

    A step takes, of the links of sufficient separation that lead on, the one that shares most owners with the walk's
    start, owners that meet the start or the link more than once not counted, ties to the least end. A walk ends without an edge if fewer than
    least_for_link are shared or a segment comes back; it ends with one where least_for_segment owners are common and the raw Jaccard similarity
    is at least least_jaccard. A start that is met again is like itself. segments holds the segments in between, in the links' direction.

    visits has (owner, segment), steps the transitions (owner, s0, s1), found_links (s0, s1, separation), pairs segment_pairs().
    All walks go one step a round; one row a walk is kept.
    """
    ground = _Ground(visits, steps, found_links, pairs, owner, segment, forward, options)
    kind = dict(ground.ahead.dtypes)["at"]
    state = materialize(ground.ahead.select(F.col("at").alias("start")).distinct().select("start", F.col("start").alias("ref"), F.col("start").alias("at"), F.array().cast(f"array<{kind}>").alias("path")), "walk")
    found: list[DataFrame] = []
    shape = state.select("start", F.col("at").alias("next"), "path")
    while True:
        moved = materialize(ground.step(state).where(~F.array_contains("path", F.col("next"))), "walk")
        discard(state)
        found.append(moved.where("alike").select("start", "next", "path"))
        state = materialize(moved.where("not alike").select("start", "ref", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")), "walk")
        if state.isEmpty():
            break
    done = _joined(found, shape, "walks")
    ground.leave()
    if forward:
        return done.select(F.col("start").alias("s0"), F.col("next").alias("s1"), F.col("path").alias("segments"))
    return done.select(F.col("next").alias("s0"), F.col("start").alias("s1"), F.reverse("path").alias("segments"))


def jaccard_graph(visits: DataFrame, steps: DataFrame, found_links: DataFrame, pairs: DataFrame, **named) -> DataFrame:
    """(s0, s1, forward, backward, segments): edges found by walks in either direction, strong ones in both; the forward walk's segments come first."""
    f = jaccard_walks(visits, steps, found_links, pairs, forward=True, **named).withColumnRenamed("segments", "f")
    b = jaccard_walks(visits, steps, found_links, pairs, forward=False, **named).withColumnRenamed("segments", "b")
    return f.join(b, ["s0", "s1"], "full").select("s0", "s1", F.col("f").isNotNull().alias("forward"), F.col("b").isNotNull().alias("backward"), F.coalesce("f", "b").alias("segments"))


def assembly_paths(starts: DataFrame, visits: DataFrame, steps: DataFrame, found_links: DataFrame, pairs: DataFrame, *, forward: bool = True, owner: str = "owner", segment: str = "segment", options: WalkOptions = WalkOptions()) -> DataFrame:
    """(start, idx, segment, is_primary, previous, next): the path from each of `starts` (segment), whose reference moves along.

    Steps are those of jaccard_walks(), but a segment like the reference joins the path as a primary one, with all
    segments since the last, and becomes the new reference; the others carry the primary ones around them, in the links' direction. A path ends where no link
    shares enough owners with the reference, or a pair of reference and segment comes back; what lies behind its last primary segment is left out.
    """
    ground = _Ground(visits, steps, found_links, pairs, owner, segment, forward, options)
    kind = dict(ground.ahead.dtypes)["at"]
    empty = F.array().cast(f"array<{kind}>")
    begun = starts.select(F.col(segment).cast(kind).alias("start")).distinct()
    state = begun.select("start", F.col("start").alias("ref"), F.col("start").alias("at"), empty.alias("waiting"), F.array().cast(f"array<struct<ref: {kind}, at: {kind}>>").alias("seen"), F.lit(0).cast("long").alias("n"))
    state = materialize(state, "path")
    none = F.lit(None).cast(kind)
    parts = [begun.select("start", F.lit(0).cast("long").alias("idx"), F.col("start").alias("segment"), F.lit(True).alias("is_primary"), none.alias("previous"), none.alias("next"))]
    old = []
    while True:
        here = F.struct("ref", F.col("next").alias("at"))
        moved = materialize(ground.step(state).where(~F.array_contains("seen", here)), "path")
        parts.append(_path_rows(moved.where("alike"), forward))
        on = moved.select(
            "start", F.when(F.col("alike"), F.col("next")).otherwise(F.col("ref")).alias("ref"), F.col("next").alias("at"),
            F.when(F.col("alike"), empty).otherwise(F.concat("waiting", F.array("next"))).alias("waiting"), F.concat("seen", F.array(here)).alias("seen"),
            (F.col("n") + F.when(F.col("alike"), F.size("waiting") + 1).otherwise(0)).alias("n"),
        )
        discard(state)
        old.append(moved)
        state = materialize(on, "path")
        if state.isEmpty():
            break
    out = materialize(_union(parts), "paths")
    discard(*old)
    ground.leave()
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _path_rows(moved: DataFrame, forward: bool) -> DataFrame:
    before, behind = ("ref", "next") if forward else ("next", "ref")
    rows = moved.select("start", "ref", F.col("next").alias("goal"), "n", F.posexplode(F.concat("waiting", F.array("next"))).alias("i", "segment"))
    primary: Column = F.col("segment") == F.col("goal")
    ends = {"ref": F.col("ref"), "next": F.col("goal")}
    return rows.select(
        "start", (F.col("n") + F.col("i") + 1).alias("idx"), "segment", primary.alias("is_primary"), F.when(~primary, ends[before]).alias("previous"), F.when(~primary, ends[behind]).alias("next"),
    )
