"""Sequences of bubble chains: common ends moved to neighbours (D23), phasing regions (D20) and the three forms of output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.shipping import ship
from weftgraph.storage import materialize


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many characters two strings begin with alike."""

    def length(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:  # halves, each compared at once
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
        return low

    return pd.Series([length(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def transfer_counts(branches: DataFrame) -> DataFrame:
    """(chain, position, backward, forward): what each bubble gives to the edges before and behind it.

    branches has (chain, position, branch, sequence): an edge of a chain is a bubble if it has several branches. A bubble gives the common prefix
    of all its branches to the edge before and the common suffix to the one behind, but only if it has both neighbours and neither is a bubble. Where
    the two would overlap in the shortest branch, they give way by turns, the prefix first. The prefix that the least and the greatest
    of some strings share is that of them all.
    """
    ship(branches.sparkSession)
    shared = F.pandas_udf(_shared, "int")
    turned = F.reverse(F.coalesce("sequence", F.lit("")))
    edges = branches.groupBy("chain", "position").agg(
        F.count("*").alias("ploidy"), F.min(F.coalesce("sequence", F.lit(""))).alias("low"), F.max(F.coalesce("sequence", F.lit(""))).alias("high"), F.min(turned).alias("tlow"), F.max(turned).alias("thigh"),
        F.min(F.length(F.coalesce("sequence", F.lit("")))).alias("shortest"),
    )
    by = Window.partitionBy("chain").orderBy("position")
    between = (F.lag("ploidy").over(by) == 1) & (F.lead("ploidy").over(by) == 1)
    bubbles = edges.withColumn("between", between).where("ploidy > 1 and between")
    counted = bubbles.withColumns({"b": shared("low", "high"), "f": shared("tlow", "thigh")})
    over = F.greatest(F.col("b") + F.col("f") - F.col("shortest"), F.lit(0))
    return counted.select("chain", "position", (F.col("b") - F.ceil(over / 2)).cast("int").alias("backward"), (F.col("f") - F.floor(over / 2)).cast("int").alias("forward"))


def transfer(branches: DataFrame) -> DataFrame:
    """The branches with the sequences they have once every bubble has given its common ends away; other columns stay.

    All bubbles give at once: an edge between two of them gets the suffix of the one and the prefix of the other, so every way through a
    chain still spells the same. A null sequence counts as empty.
    """
    counts = materialize(transfer_counts(branches), "transfer")
    sample = branches.groupBy("chain", "position").agg(F.min(F.coalesce("sequence", F.lit(""))).alias("low"))
    given = counts.join(sample, ["chain", "position"]).select(
        "chain", "position", "backward", "forward", F.substring("low", F.lit(1), F.col("backward")).alias("prefix"), F.expr("right(low, forward)").alias("suffix")
    )
    by = Window.partitionBy("chain").orderBy("position")
    places = branches.select("chain", "position").distinct().join(given, ["chain", "position"], "left")
    ends = places.select(
        "chain", "position", F.coalesce("backward", F.lit(0)).alias("cut"), F.coalesce("forward", F.lit(0)).alias("back"),
        F.coalesce(F.lag("suffix").over(by), F.lit("")).alias("head"), F.coalesce(F.lead("prefix").over(by), F.lit("")).alias("tail"),
    )
    own = F.coalesce("sequence", F.lit(""))
    core = F.substring(own, F.col("cut") + 1, F.length(own) - F.col("cut") - F.col("back"))
    return branches.join(ends, ["chain", "position"]).withColumn("sequence", F.concat("head", core, "tail")).select(branches.columns)


def phasing_spans(branches: DataFrame) -> DataFrame:
    """(chain, position, region, component): the phasing region of every edge of a chain.

    Consecutive bubbles of one component, with all edges between the first and the last of them, are a phased region; what
    lies before, between and behind these is unphased (component null). branches has (chain, position, component), null for edges that aren't phased bubbles.
    """
    edges = branches.groupBy("chain", "position").agg(F.max("component").alias("component"))
    by = Window.partitionBy("chain").orderBy("position")
    back = Window.partitionBy("chain").orderBy(F.desc("position"))
    # both frames grow row by row; one that shrinks towards the end would be gone through anew for every row
    upto, since = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (by, back))
    seen = edges.select("chain", "position", F.last("component", True).over(upto).alias("before"), F.last("component", True).over(since).alias("behind"), "component")
    # an edge between two bubbles of one component lies in their region, if no other component came in between: the next phased bubble is the next one
    phased = seen.withColumn("component", F.when(F.col("before") == F.col("behind"), F.col("before")))
    changed = ~F.col("component").eqNullSafe(F.lag("component").over(by)) | F.lag("position").over(by).isNull()
    return phased.withColumn("open", F.coalesce(changed, F.lit(True)).cast("int")).select("chain", "position", (F.sum("open").over(by) - 1).alias("region"), "component")


def _spelled(rows: DataFrame, *key: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", "sequence")))
    return rows.groupBy(*key).agg(ordered.alias("v")).select(*key, F.array_join(F.transform("v", lambda x: x["sequence"]), "").alias("sequence"))


def _strongest(branches: DataFrame) -> DataFrame:
    by = Window.partitionBy("chain", "position").orderBy(F.desc_nulls_last("coverage"), "branch")
    return branches.withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")


def detailed(branches: DataFrame) -> DataFrame:
    """(name, chain, place, sequence): every branch of every edge on its own; place orders what follows what in a chain."""
    name = F.concat_ws(".", F.col("chain"), F.col("position"), F.col("branch"))
    return branches.select(name.alias("name"), "chain", F.col("position").alias("place"), F.coalesce("sequence", F.lit("")).alias("sequence"))


def haploid(branches: DataFrame) -> DataFrame:
    """One sequence a chain, of each edge's branch of highest coverage, ties to the least branch."""
    rows = _strongest(branches).withColumn("sequence", F.coalesce("sequence", F.lit("")))
    return _spelled(rows, "chain").select(F.concat(F.lit("H."), "chain").alias("name"), "chain", F.lit(0).cast("long").alias("place"), "sequence")


def phased(branches: DataFrame) -> DataFrame:
    """(name, chain, place, sequence): two haplotypes for each phased region of a chain, one sequence for each unphased one.

    branches has (chain, position, branch, sequence, coverage, component, phase): haplotype h takes, of a phased bubble of two branches, branch
    h if phase is 0 and the other if it is 1; of any other edge the branch of highest coverage, ties to the least.
    """
    spans = materialize(phasing_spans(branches), "spans")
    rows = branches.withColumn("sequence", F.coalesce("sequence", F.lit("")))
    order = F.row_number().over(Window.partitionBy("chain", "position").orderBy("branch")) - 1
    ranked = rows.withColumn("side", order)
    two = ranked.where("component is not null").select("chain", "position", "sequence", F.col("side").bitwiseXOR(F.coalesce("phase", F.lit(0)).cast("int")).alias("haplotype")).where("haplotype in (0, 1)")
    one = _strongest(rows).where("component is null").select("chain", "position", "sequence")
    placed = spans.select("chain", "position", "region", F.col("component").alias("of"))
    both = one.withColumn("haplotype", F.explode(F.array(F.lit(0), F.lit(1))))
    pieces = both.unionByName(two).join(placed, ["chain", "position"]).where("of is not null or haplotype = 0")
    told = _spelled(pieces, "chain", "region", "of", "haplotype")
    name = F.when(F.col("of").isNull(), F.concat_ws(".", F.lit("UR"), "chain", "region")).otherwise(F.concat_ws(".", F.lit("PR"), "chain", "region", "of", "haplotype"))
    return told.select(name.alias("name"), "chain", F.col("region").alias("place"), "sequence")


def joined(pieces: DataFrame) -> DataFrame:
    """The links between the sequences of one form: (from_id, to_id, from_strand, to_strand, cigar) of all neighbours of a chain, for sinks.gfa_lines()."""
    places = pieces.select("chain", "place").distinct()
    follows = places.select("chain", "place", F.lead("place").over(Window.partitionBy("chain").orderBy("place")).alias("next")).where("next is not null")
    a = pieces.select("chain", "place", F.col("name").alias("from_id")).join(follows, ["chain", "place"])
    b = pieces.select("chain", F.col("place").alias("next"), F.col("name").alias("to_id"))
    return a.join(b, ["chain", "next"]).select("from_id", "to_id", F.lit("+").alias("from_strand"), F.lit("+").alias("to_strand"), F.lit("0M").alias("cigar"))
