"""Bubbles and phasing (D1-D22; superbubbles, D6, are in superbubbles.py, sequences and outputs, D20, D23 and W5, in haplotypes.py)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.assembly_graph import compress, linear_chains
from weftgraph.operators.graph import connected_components, spanning_forest
from weftgraph.operators.marker_graph import degrees
from weftgraph.operators.read_graph import both_ways
from weftgraph.storage import materialize


def gather_bubbles(edges: DataFrame) -> DataFrame:
    """(src, dst, branches array<eid>, ploidy) of vertex pairs with two or more parallel edges."""
    return edges.groupBy("src", "dst").agg(F.array_sort(F.collect_list("eid")).alias("branches"), F.count("*").alias("ploidy")).where("ploidy >= 2")


def ploidy_histogram(edges: DataFrame) -> DataFrame:
    """Vertex pairs by their number of parallel edges."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("ploidy")).groupBy("ploidy").agg(F.count("*").alias("n"))


def remove_short_loopbacks(edges: DataFrame, least: int, length: str = "length") -> DataFrame:
    """Without edges shorter than `least` that lead back to their source."""
    return edges.where((F.col("src") != F.col("dst")) | (F.col(length) >= least))


def branch_reads(members: DataFrame, *branch: str, member: str = "member", value: str = "coverage") -> DataFrame:
    """(*branch, reads array, min, avg and max of `value`)."""
    return members.groupBy(*branch).agg(F.array_sort(F.collect_set(member)).alias("reads"), F.min(value).alias("min_coverage"), F.round(F.avg(value), 6).alias("avg_coverage"), F.max(value).alias("max_coverage"))


def remove_weak_branches(branches: DataFrame, least: int = 2, *, bubble: list[str], reads: str = "reads", key: str = "eid") -> DataFrame:
    """Without branches of fewer than `least` reads, but never without a bubble's strongest, ties to the least key."""
    order = Window.partitionBy(*bubble).orderBy(F.desc(reads), key)
    return branches.withColumn("rank", F.row_number().over(order)).where((F.col("rank") == 1) | (F.col(reads) >= least)).drop("rank")


def force_maximum_ploidy(branches: DataFrame, ploidy: int, *, bubble: list[str], score: str = "avg_coverage", key: str = "eid") -> DataFrame:
    """The `ploidy` branches of highest average coverage of each bubble."""
    order = Window.partitionBy(*bubble).orderBy(F.desc(score), key)
    return branches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ploidy).drop("rank")


def remove_degenerate_branches(branches: DataFrame, *, bubble: list[str], sequence: str = "sequence", score: str = "avg_coverage", key: str = "eid") -> DataFrame:
    """Of a bubble's branches with equal sequences, the one of highest average coverage."""
    order = Window.partitionBy(*bubble, sequence).orderBy(F.desc(score), key)
    return branches.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def merge_nonbubbles(edges: DataFrame) -> DataFrame:
    """Chains of edges that aren't part of a bubble, merged."""
    single = edges.join(gather_bubbles(edges).select("src", "dst"), ["src", "dst"], "left_anti")
    return compress(single)


def remove_secondary(edges: DataFrame, flag: str = "is_secondary") -> DataFrame:
    """bubbles' secondary branches go where a primary one exists."""
    primary = F.bool_or(~F.col(flag)).over(Window.partitionBy("src", "dst"))
    return edges.withColumn("primary", primary).where(~F.col(flag) | ~F.col("primary")).drop("primary")


def prune_branches(edges: DataFrame, least: int, length: str = "length") -> DataFrame:
    """D3: leaves all of whose parallel branches are shorter than `least` go, until none is left."""
    left = edges
    while True:
        d = degrees(left)
        short = F.bool_and(F.col(length) < least).over(Window.partitionBy("src", "dst"))
        marked = left.withColumn("short", short).join(d.select(F.col("node").alias("src"), F.col("in_degree").alias("i")), "src").join(d.select(F.col("node").alias("dst"), F.col("out_degree").alias("o")), "dst")
        kept = materialize(marked.where("not (short and (i = 0 or o = 0))").select(edges.columns), "branches")
        if kept.count() == left.count():
            return kept
        left = kept


def phasing_matrix(sides: DataFrame, member: str = "member") -> DataFrame:
    """(a, b, m00, m01, m10, m11): members two diploid bubbles (bubble, member, side 0 or 1) share, by side.

    Members on both sides of a bubble count for neither.
    """
    clean = sides.select("bubble", member, "side").distinct().withColumn("n", F.count("*").over(Window.partitionBy("bubble", member))).where("n = 1")
    a = clean.select(F.col("bubble").alias("a"), member, F.col("side").alias("sa"))
    b = clean.select(F.col("bubble").alias("b"), member, F.col("side").alias("sb"))
    cells = [F.count_if((F.col("sa") == i) & (F.col("sb") == j)).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1)]
    return a.join(b, member).where("a < b").groupBy("a", "b").agg(*cells)


def log_ratios(epsilon: float = 0.1, m: tuple[str, str, str, str] = ("m00", "m01", "m10", "m11")) -> tuple[Column, Column]:
    """Decibels by which "in phase" and "out of phase" explain a 2x2 matrix better than "random".

    Random spreads the members over the cells by their marginals. The others put all on one diagonal, by its cells' marginals, and
    mix in epsilon of random. A matrix without members, or a hypothesis without any cell that could hold one, gives null.
    """
    m00, m01, m10, m11 = (F.col(c).cast("double") for c in m)
    n = m00 + m01 + m10 + m11
    row, col = (m00 + m01, m10 + m11), (m00 + m10, m01 + m11)
    cells = ((m00, m01), (m10, m11))

    def db(diagonal: bool) -> Column:
        on = [(i, j) for i in (0, 1) for j in (0, 1) if (i == j) == diagonal]
        whole = F.nullif(sum(row[i] * col[j] for i, j in on), F.lit(0.0))
        out = F.lit(0.0)
        for i in (0, 1):
            for j in (0, 1):
                random = row[i] * col[j] / F.nullif(n * n, F.lit(0.0))
                share = epsilon * random
                if (i, j) in on:
                    share = share + (1 - epsilon) * row[i] * col[j] / whole
                out = out + F.when(cells[i][j] > 0, cells[i][j] * 10 * F.log10(share / random)).otherwise(0.0)
        return F.when(n > 0, out)

    return db(True), db(False)


def phase_scores(matrices: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """D14 on a table: adds log_in and log_out, rounded to 6 digits."""
    in_, out = log_ratios(epsilon)
    return matrices.withColumns({"log_in": F.round(in_, 6), "log_out": F.round(out, 6)})


def hypothesis(scores: DataFrame, *, allow_random: bool = True) -> DataFrame:
    """(phase 0 or 1, log_p): the better of in and out of phase; log_p is how far it leads the other and, if random is allowed, random too."""
    better, other = F.greatest("log_in", "log_out"), F.least("log_in", "log_out")
    log_p = F.least(better - other, better) if allow_random else better - other
    return scores.withColumns({"phase": F.when(F.col("log_in") >= F.col("log_out"), 0).otherwise(1), "log_p": F.round(log_p, 6)})


def phasing_edges(sides: DataFrame, *, min_concordant: int = 6, max_discordant: int = 1, min_log_p: float = 10.0, epsilon: float = 0.1) -> DataFrame:
    """Bubble pairs with enough members on one diagonal, few on the other, and a clear hypothesis."""
    m = phasing_matrix(sides)
    diagonal, off = F.col("m00") + F.col("m11"), F.col("m01") + F.col("m10")
    kept = m.where((F.greatest(diagonal, off) >= min_concordant) & (F.least(diagonal, off) <= max_discordant))
    return hypothesis(phase_scores(kept, epsilon)).where(F.col("log_p") > min_log_p)


def phase_tree(forest: DataFrame) -> DataFrame:
    """(node, component, phase): phases along the tree's edges (a, b, phase) from each component's least node."""
    steps = materialize(both_ways(forest.select("a", "b", "phase"), "a", "b"), "phases")
    label = connected_components(forest)
    done = label.where("node = component").select("node", "component", F.lit(0).alias("phase"))
    front = done
    while True:
        found = front.withColumnRenamed("phase", "p").join(steps, "node").select(F.col("other").alias("node"), "component", F.col("p").bitwiseXOR(F.col("phase")).alias("phase"))
        front = materialize(found.join(done.select("node"), "node", "left_anti"), "phases")
        if front.isEmpty():
            return done
        done = materialize(done.unionByName(front), "phases")


def remove_bad_bubbles(sides: DataFrame, distances: DataFrame | None = None, *, least_size: int = 10, least_distance: int = 10, **options) -> DataFrame:
    """Bubbles left once those in phasing components of fewer than `least_size` went, again and again; bubbles whose branches differ by more
    than `least_distance` edits (distances: bubble, distance) stay in any case.
    """
    left = sides
    while True:
        edges = materialize(phasing_edges(left, **options), "bubbles")
        parts = connected_components(edges)
        sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
        good = parts.join(sizes, "component").where(F.col("size") >= least_size).select(F.col("node").alias("bubble"))
        if distances is not None:
            good = good.unionByName(distances.where(F.col("distance") > least_distance).select("bubble")).distinct()
        kept = materialize(left.join(good, "bubble", "left_semi"), "bubbles")
        if kept.select("bubble").distinct().count() == left.select("bubble").distinct().count():
            return kept
        left = kept


def hierarchical_phase(sides: DataFrame, rounds: int | None = None, **options) -> DataFrame:
    """(bubble, component, phase): phase, merge each component into one bubble with its sides turned by phase, and go on with these.

    Every round joins components, so it ends by itself where none are joined; `rounds` stops it before.
    """
    at = sides.select("bubble").distinct().select("bubble", F.col("bubble").alias("component"), F.lit(0).alias("phase"))
    now = sides.select("bubble", "member", "side")
    for _ in itertools.count() if rounds is None else range(rounds):
        tree = spanning_forest(phasing_edges(now, **options))
        if tree.isEmpty():
            break
        found = materialize(phase_tree(tree), "phased")
        turn = found.select(F.col("node").alias("old"), F.col("component").alias("new"), F.col("phase").alias("turn"))
        at = materialize(at.join(turn, at["component"] == turn["old"], "left").select("bubble", F.coalesce("new", "component").alias("component"), F.col("phase").bitwiseXOR(F.coalesce("turn", F.lit(0))).alias("phase")), "phased")
        votes = now.join(turn, now["bubble"] == turn["old"], "left").select(F.coalesce("new", "bubble").alias("bubble"), "member", F.col("side").bitwiseXOR(F.coalesce("turn", F.lit(0))).alias("side"))
        counted = votes.groupBy("bubble", "member").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        now = materialize(counted.where("n0 != n1").select("bubble", "member", F.when(F.col("n0") > F.col("n1"), 0).otherwise(1).alias("side")), "phased")
    return at


def bubble_chains(bubbles: DataFrame) -> DataFrame:
    """(eid, chain, position) of chains of edges and bubbles (src, dst, eid), a bubble counted as one edge."""
    return linear_chains(bubbles.groupBy("src", "dst").agg(F.min("eid").alias("eid")).select("eid", "src", "dst"))


def copy_number_period(a: str, b: str, longest: int = 8) -> int:
    """The period of which one sequence has more copies than the other where they differ only so; 0 if they don't."""
    if len(a) == len(b):
        return 0
    short, long = sorted((a, b), key=len)
    p = 0
    while p < len(short) and short[p] == long[p]:
        p += 1
    extra = len(long) - len(short)
    for at in range(p + 1):
        if short[:at] == long[:at] and short[at:] == long[at + extra :]:
            piece = long[at : at + extra]
            for period in range(1, longest + 1):
                unit = piece[:period]
                if extra % period == 0 and unit * (extra // period) == piece and (long[at + extra :].startswith(unit) or long[:at].endswith(unit)):
                    return period
    return 0


def common_prefix(sequences: Column) -> Column:
    """The longest common prefix of an array of strings; with reverse() before and after, the suffix."""

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k.cast("int")) == F.substring(b, F.lit(1), k.cast("int")))
        return a.substr(F.lit(1), F.array_max(same))

    return F.aggregate(F.slice(sequences, 2, F.greatest(F.size(sequences), F.lit(1))), F.element_at(sequences, 1), shared)
