"""Queries on marker graphs, assembly graphs, consensus, phasing, journeys and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import assembly_graph as B
from weftgraph.operators import consensus as N
from weftgraph.operators import journeys as J
from weftgraph.operators import marker_graph as G
from weftgraph.operators import phasing as D
from weftgraph.operators import sinks as W
from weftgraph.plans.common import table
from weftgraph.plans.overlaps import _CHAIN, _chains
from weftgraph.storage import materialize

# ---- Marker graph: users are reads, events markers; a vertex is an event type on a day --------------


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    vid = F.dayofyear("ts") * 100 + F.ascii("event_type") % 100
    return table(spark, sf_dir, "events").select(vid.cast("long").alias("vid"), F.col("user_id").alias("oriented_id"), (F.row_number().over(order) - 1).cast("int").alias("ordinal"), "props")


def _edges(spark, sf_dir) -> DataFrame:
    return materialize(G.create_edges(_vertices(spark, sf_dir).drop("props")), "edges")


def marker_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst", "coverage", F.size("intervals").cast("long").alias("n"), F.aggregate("intervals", F.lit(0).cast("long"), lambda a, x: a + x["oriented_id"] * x["o0"]).alias("checksum"))


def strict_edges(spark, sf_dir):
    v = _vertices(spark, sf_dir)
    return G.strict_edges(v.drop("props"), v.select("oriented_id", F.col("ordinal").alias("o0"), F.col("props").alias("sequence")), 1, 0, stranded=False)


def _forward(spark, sf_dir) -> DataFrame:
    """A sparse acyclic graph: transitions to a later day, with an edge id."""
    e = _edges(spark, sf_dir).where(F.floor(F.col("src") / 100) < F.floor(F.col("dst") / 100))
    return e.select((F.col("src") * 100_000 + F.col("dst")).alias("eid"), "src", "dst", "coverage")


def _all_edges(spark, sf_dir) -> DataFrame:
    """All transitions, circles included, with an edge id."""
    return _edges(spark, sf_dir).select((F.col("src") * 100_000 + F.col("dst")).alias("eid"), "src", "dst", "coverage")


def secondary_edges(spark, sf_dir):
    order = Window.partitionBy("oriented_id").orderBy("ordinal")
    steps = _vertices(spark, sf_dir).select(F.col("vid").alias("src"), F.lead("vid").over(order).alias("dst")).where("dst is not null")
    edges = _edges(spark, sf_dir)
    usual = edges.agg((1.9 * F.avg("coverage")).alias("usual"))  # one row: edges that stand out leave dead ends
    return G.secondary_edges(edges.join(F.broadcast(usual), F.col("coverage") > F.col("usual")), steps, aggressive=True)


def prune_leaves(spark, sf_dir):
    return G.prune_leaves(_forward(spark, sf_dir))


def marker_vertices(spark, sf_dir):
    return G.create_vertices(_chains(spark, sf_dir), min_coverage=2, max_coverage=100)


def _supplies(spark, sf_dir) -> DataFrame:
    """Parallel edges: each line item leads from its part to its supplier."""
    eid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(eid.alias("eid"), F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), F.col("l_quantity").cast("long").alias("coverage"), F.floor("l_extendedprice").cast("long").alias("length"), "l_returnflag", "l_orderkey")


def edit_clusters(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    return G.cluster_by_distance(parts, ["p_brand"], "p_partkey", "p_name", 0.25)


# ---- Assembly graph ----------------------------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    """Every order leads from the customer's last order to the next."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("eid"), F.coalesce(F.lag("o_orderkey").over(order), -F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"), F.floor("o_totalprice").cast("long").alias("coverage"))
    return materialize(rows, "orders")


def linear_chains(spark, sf_dir):
    return B.linear_chains(_orders(spark, sf_dir).select("eid", "src", "dst"))


def chain_coverage(spark, sf_dir):
    edges = _orders(spark, sf_dir)
    return B.chain_coverage(edges.drop("coverage"), B.linear_chains(edges), edges.select(F.col("dst").alias("vid"), "coverage").unionByName(edges.where("src < 0").select(F.col("src").alias("vid"), F.lit(0).cast("long").alias("coverage"))))


def compressed_edges(spark, sf_dir):
    found = B.compress(_orders(spark, sf_dir))
    return found.select("chain", "src", "dst", "length", F.md5(F.array_join(F.transform("path", lambda x: x.cast("string")), ",")).alias("path"))


def _tangle(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Around each supplier, in-edges by low and high price and out-edges by low and high quantity; orders are members."""
    items = table(spark, sf_dir, "lineitem")
    s = F.col("l_suppkey") * 100
    into = s + F.when(F.col("l_extendedprice") < 53_000, 0).otherwise(1)
    out = s + 60 + F.when(F.col("l_quantity") <= 25, 0).otherwise(1)
    a = items.select(into.alias("eid"), (-into).alias("src"), (s + 50).alias("dst"), F.col("l_orderkey").alias("member"))
    m = items.select((s + 50).alias("eid"), (s + 50).alias("src"), (s + 51).alias("dst"), F.col("l_orderkey").alias("member"))
    b = items.select(out.alias("eid"), (s + 51).alias("src"), (-out).alias("dst"), F.col("l_orderkey").alias("member"))
    every = a.unionByName(m).unionByName(b)
    return every.select("eid", "src", "dst").distinct(), every.select("eid", "member").distinct()


def tangle_matrices(spark, sf_dir):
    return B.tangle_matrices(*_tangle(spark, sf_dir))


#: Limits that resolve some suppliers' tangles and leave others.
_DOMINANT = {"most_off": 20, "most_ratio": 0.9}


def tangle_solvable(spark, sf_dir):
    return B.solvable_by_dominance(materialize(tangle_matrices(spark, sf_dir), "tangles"), **_DOMINANT)


def detangle(spark, sf_dir):
    """How many members each edge has once the tangles are resolved; (src, dst) name it, as new edges have new numbers."""
    edges, members = B.detangle(*_tangle(spark, sf_dir), strict=False, **_DOMINANT)
    return edges.join(members.groupBy("eid").agg(F.count("*").alias("members")), "eid", "left").select("src", "dst", F.coalesce("members", F.lit(0)).cast("long").alias("members"))


def pseudo_paths(spark, sf_dir):
    return B.pseudo_paths(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def key_segments(spark, sf_dir):
    chains = _forward(spark, sf_dir).withColumnRenamed("eid", "chain")
    return B.key_segments(chains)


def subset_graph(spark, sf_dir):
    return B.subset_graph(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


# ---- Consensus: a part is a position, its line items the observations -------------------------------


def _observations(spark, sf_dir) -> DataFrame:
    base = F.translate("l_returnflag", "ANR", "ACG")
    return table(spark, sf_dir, "lineitem").select("l_partkey", base.alias("base"), (F.col("l_suppkey") % 2).cast("int").alias("strand"), F.col("l_quantity").cast("int").alias("repeat"))


def consensus_bayesian(spark, sf_dir):
    return N.consensus_caller("Bayesian", spark)(_observations(spark, sf_dir), "l_partkey")


def snp_statistics(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.translate("l_returnflag", "ANR", "ACG").alias("a"), F.translate("l_linestatus", "FO", "CT").alias("b"))
    return N.snp_statistics(pairs)


# ---- Phasing: a nation is a bubble, its customers' part pairs the members -----------------------------


def _sides(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("long").alias("bubble"), F.col("l_suppkey").alias("member"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("side")
    ).groupBy("bubble", "member").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0")).select("bubble", "member", F.when(F.col("n1") * 3 > F.col("n0"), 1).otherwise(0).alias("side"))


_LOOSE = {"min_concordant": 10, "max_discordant": 60, "min_log_p": -1e6}


def phasing_edges(spark, sf_dir):
    return D.phasing_edges(_sides(spark, sf_dir), **_LOOSE).select("a", "b", "m00", "m01", "m10", "m11", "log_in", "log_out", "phase", "log_p")


def phase_scores(spark, sf_dir):
    return D.hypothesis(D.phase_scores(D.phasing_matrix(_sides(spark, sf_dir))))


# ---- Journeys: event types as segments ----------------------------------------------------------------


def _journeys(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("minute", F.expr("cast(floor(unix_micros(cast(ts as timestamp)) / 60000000) as bigint)"))
    day = F.concat_ws(":", "event_type", (F.dayofyear("ts") % 7).cast("string"))
    return J.segment_journeys(e.withColumn("segment", day), "user_id", ["minute", "event_id"], "segment")


def _steps(spark, sf_dir):
    return J.transitions(_journeys(spark, sf_dir), "user_id", "segment").withColumn("gap", F.col("first1") - F.col("last0"))


def _links(spark, sf_dir, least=3):
    return J.links(_steps(spark, sf_dir), least, "gap")


def _main_links(spark, sf_dir):
    """Every segment's link of highest coverage, ties to the least end."""
    return _links(spark, sf_dir).groupBy("s0").agg(F.min_by("s1", F.struct((-F.col("coverage")).alias("c"), "s1")).alias("s1"))


def _members(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.ascii("event_type").cast("long").alias("segment"), F.col("event_id").alias("at"))
    return J.segment_members(e, "owner", "segment", "at")


def segment_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spans = e.groupBy(F.col("user_id").alias("owner")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    lengths = e.groupBy(F.ascii("event_type").cast("long").alias("segment")).agg(F.lit(100).cast("long").alias("length"))
    return J.segment_pairs(_members(spark, sf_dir), spans, lengths)


# ---- Outputs ---------------------------------------------------------------------------------------------


def gfa_lines(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.upper(F.regexp_replace("p_name", "[^a-zA-Z]", "")).alias("sequence"), F.col("p_size").alias("reads"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(order).alias("to_id"), F.lit("+").alias("from_strand"), F.lit("+").alias("to_strand"), F.lit("0M").alias("cigar")).where("to_id is not null").distinct()
    return W.gfa_lines(parts, links)


def cigar(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    left, right = F.transform("x", lambda v: v["q"]), F.transform("x", lambda v: v["q"] % 7 + 1)
    return rows.select("l_orderkey", W.run_length_cigar(left, right).alias("cigar"))


def read_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "n_chars")
    return W.read_summary(docs, labels=table(spark, sf_dir, "labels").select(F.col("doc_id").alias("read_id")), turns=table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("read_id")))


def _bubble_branches(spark, sf_dir):
    return _supplies(spark, sf_dir).withColumnRenamed("coverage", "avg_coverage")


QUERIES = {
    "marker_edges": marker_edges, "strict_edges": strict_edges, "secondary_edges": secondary_edges, "prune_leaves": prune_leaves, "marker_vertices": marker_vertices,
    "next_vertices": lambda s, d: G.next_vertices(_vertices(s, d).drop("props"), 1),
    "intervals_between": lambda s, d: G.intervals_between(_vertices(s, d).drop("props"), 101, 201),
    "parallel_edges": lambda s, d: G.parallel_edges(_supplies(s, d)),
    "degrees": lambda s, d: G.degrees(_forward(s, d)).withColumn("first_out", F.coalesce("first_out", F.lit(-1))),
    "coverage_histogram": lambda s, d: G.coverage_histogram(_edges(s, d)),
    "edge_paths": lambda s, d: G.edge_paths(_vertices(s, d).drop("props"), _forward(s, d)),
    "induced_alignment": lambda s, d: G.induced_alignment(marker_vertices(s, d)),
    "duplicate_markers": lambda s, d: G.duplicate_markers(_vertices(s, d).drop("props")),
    "cleanup_duplicates": lambda s, d: G.cleanup_duplicates(_vertices(s, d).drop("props")),
    "best_parallel": lambda s, d: G.best_parallel(_supplies(s, d), "coverage").select("eid", "src", "dst"),
    "transitive_reduction": lambda s, d: G.transitive_reduction(_forward(s, d)),
    "reverse_transitive_reduction": lambda s, d: G.transitive_reduction(_all_edges(s, d), backward=True),
    "simplify_superbubbles": lambda s, d: G.simplify_superbubbles(_forward(s, d).withColumn("length", F.floor(F.col("dst") / 100) - F.floor(F.col("src") / 100)), 2),
    "edit_distance_clusters": edit_clusters,
    "split_clusters": lambda s, d: G.split_by_cluster(edit_clusters(s, d), ["p_brand"], 2),
    "linear_chains": linear_chains, "chain_coverage": chain_coverage, "compressed_edges": compressed_edges,
    "cross_edges": lambda s, d: B.low_coverage_cross_edges(_forward(s, d), 1),
    "prune_short_leaves": lambda s, d: B.prune_short_leaves(B.compress(_orders(s, d)), 8).select("chain", "src", "dst", "length"),
    "tangle_matrices": tangle_matrices, "tangle_solvable": tangle_solvable, "detangle": detangle, "pseudo_paths": pseudo_paths, "key_segments": key_segments, "subset_graph": subset_graph,
    "merge_parallel": lambda s, d: B.merge_parallel(_supplies(s, d).withColumnRenamed("eid", "chain")).select("src", "dst", F.array_join(F.transform("chains", lambda x: x.cast("string")), ",").alias("chains")),
    "observation_coverage": lambda s, d: N.coverage(_observations(s, d), "l_partkey"),
    "deduplicate_and_count": lambda s, d: N.deduplicate_and_count(_observations(s, d), "base", "repeat"),
    "most_frequent_base": lambda s, d: N.most_frequent_base(_observations(s, d), "l_partkey"),
    "consensus_modal": lambda s, d: N.modal(_observations(s, d), "l_partkey"),
    "consensus_median": lambda s, d: N.median_by_coverage(_observations(s, d), "l_partkey"),
    "consensus_bayesian": consensus_bayesian, "snp_statistics": snp_statistics,
    "gather_bubbles": lambda s, d: D.gather_bubbles(_supplies(s, d)).select("src", "dst", "ploidy", F.element_at("branches", 1).alias("first")),
    "ploidy_histogram": lambda s, d: D.ploidy_histogram(_supplies(s, d)),
    "weak_branches": lambda s, d: D.remove_weak_branches(_supplies(s, d), 40, bubble=["src", "dst"], reads="coverage").select("eid"),
    "maximum_ploidy": lambda s, d: D.force_maximum_ploidy(_bubble_branches(s, d), 2, bubble=["src", "dst"]).select("eid"),
    "degenerate_branches": lambda s, d: D.remove_degenerate_branches(_bubble_branches(s, d), bubble=["src", "dst"], sequence="l_returnflag").select("eid"),
    "short_loopbacks": lambda s, d: D.remove_short_loopbacks(_edges(s, d).drop("intervals"), 3, "coverage"),
    "branch_reads": lambda s, d: D.branch_reads(_supplies(s, d).withColumnRenamed("l_orderkey", "member"), "src", "dst").select("src", "dst", F.size("reads").cast("long").alias("reads"), "min_coverage", "avg_coverage", "max_coverage"),
    "phasing_matrix": lambda s, d: D.phasing_matrix(_sides(s, d)),
    "phase_scores": phase_scores, "phasing_edges": phasing_edges,
    "spanning_forest": lambda s, d: D.spanning_forest(phasing_edges(s, d)).select("a", "b", "phase", "log_p"),
    "phase_tree": lambda s, d: D.phase_tree(D.spanning_forest(phasing_edges(s, d))),
    "hierarchical_phase": lambda s, d: D.hierarchical_phase(_sides(s, d), 2, **_LOOSE),
    "segment_journeys": _journeys,
    "transitions": _steps, "links": _links,
    "back_segments": lambda s, d: J.back_segments(_main_links(s, d)),
    "segment_members": _members,
    "pair_offsets": lambda s, d: J.pair_offsets(_members(s, d), "owner", "segment"),
    "segment_pairs": segment_pairs,
    "path_graph": lambda s, d: J.path_graph(_journeys(s, d), "user_id", "segment"),
    "fasta_lines": lambda s, d: W.fasta_lines(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.upper(F.regexp_replace("p_name", "[^a-zA-Z]", "")).alias("sequence"))),
    "gfa_lines": gfa_lines, "run_length_cigar": cigar, "read_summary": read_summary,
    "summary_json": lambda s, d: W.summary_json(documents=table(s, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), orders=table(s, d, "orders").agg(F.count("*").alias("n"))),
}

_V = """v AS (
  SELECT CAST(dayofyear(ts) * 100 + ascii(event_type) % 100 AS BIGINT) AS vid, user_id AS oriented_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS ordinal, props FROM events
), st AS (
  SELECT vid AS src, lead(vid) OVER w AS dst, oriented_id, ordinal AS o0, lead(ordinal) OVER w AS o1, props FROM v WINDOW w AS (PARTITION BY oriented_id ORDER BY ordinal)
), e AS (SELECT src, dst, least(count(*), 255) AS coverage, count(*) AS n, CAST(sum(oriented_id * o0) AS BIGINT) AS checksum FROM st WHERE dst IS NOT NULL GROUP BY 1, 2),
fw AS (SELECT src * 100000 + dst AS eid, src, dst, coverage FROM e WHERE src // 100 < dst // 100)"""
_DEG = "{1} AS (SELECT coalesce(o.node, i.node) AS node, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, first_out FROM (SELECT src AS node, count(*) AS out_degree, min(dst) AS first_out FROM {0} GROUP BY 1) o FULL JOIN (SELECT dst AS node, count(*) AS in_degree FROM {0} GROUP BY 1) i ON o.node = i.node)"
_SUP = "sup AS (SELECT l_orderkey * 10 + l_linenumber AS eid, l_partkey AS src, -l_suppkey - 1 AS dst, CAST(l_quantity AS BIGINT) AS coverage, CAST(floor(l_extendedprice) AS BIGINT) AS length, l_returnflag, l_orderkey FROM lineitem)"
_ORD = """o AS (SELECT o_orderkey AS eid, o_custkey, coalesce(lag(o_orderkey) OVER w, -o_custkey - 1) AS src, CAST(floor(o_totalprice) AS BIGINT) AS coverage, row_number() OVER w - 1 AS position, first_value(o_orderkey) OVER w AS chain
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_TAN = """every AS (
  SELECT CAST(l_suppkey * 100 + CASE WHEN l_extendedprice < 53000 THEN 0 ELSE 1 END AS BIGINT) AS eid, 0 AS kind, l_suppkey AS s, l_orderkey AS m FROM lineitem UNION ALL SELECT CAST(l_suppkey * 100 + 60 + CASE WHEN l_quantity <= 25 THEN 0 ELSE 1 END AS BIGINT), 1, l_suppkey, l_orderkey FROM lineitem
), mem AS (SELECT DISTINCT eid, kind, s, m FROM every), ed AS (SELECT DISTINCT eid, kind, s FROM every),
mids AS (SELECT s FROM ed GROUP BY s HAVING count(*) FILTER (kind = 0) >= 2 AND count(*) FILTER (kind = 1) >= 2),
tm AS (SELECT i.s * 100 + 50 AS eid, i.eid AS in_eid, u.eid AS out_eid, (SELECT count(*) FROM mem a JOIN mem b ON a.m = b.m WHERE a.eid = i.eid AND b.eid = u.eid) AS common
  FROM ed i JOIN ed u ON i.s = u.s AND i.kind = 0 AND u.kind = 1 JOIN mids ON mids.s = i.s)"""
_TAN = _TAN.replace("(SELECT count(*) FROM mem a JOIN mem b ON a.m = b.m WHERE a.eid = i.eid AND b.eid = u.eid) AS common", "coalesce(c.n, 0) AS common").replace(
    "JOIN mids ON mids.s = i.s)", "JOIN mids ON mids.s = i.s LEFT JOIN (SELECT a.eid AS x, b.eid AS y, count(*) AS n FROM mem a JOIN mem b ON a.s = b.s AND a.m = b.m AND a.kind = 0 AND b.kind = 1 GROUP BY 1, 2) c ON c.x = i.eid AND c.y = u.eid)")
_SOLVED = """mx AS (SELECT *, max(common) OVER r AS rm, max(common) OVER c AS cm FROM tm WINDOW r AS (PARTITION BY eid, in_eid), c AS (PARTITION BY eid, out_eid)),
t AS (SELECT *, count(*) FILTER (common = rm) OVER (PARTITION BY eid, in_eid) AS rt, count(*) FILTER (common = cm) OVER (PARTITION BY eid, out_eid) AS ct FROM mx),
x AS (SELECT *, common = rm AND common = cm AND rt = 1 AND ct = 1 AS hit FROM t),
ok AS (SELECT eid FROM x GROUP BY eid HAVING count(DISTINCT in_eid) = count(DISTINCT out_eid) AND count(*) FILTER (hit) = count(DISTINCT in_eid) AND bool_and(CASE WHEN hit THEN common >= 1 ELSE common <= 20 OR (common <= 0.9 * rm AND common <= 0.9 * cm) END)),
sv AS (SELECT eid, in_eid, out_eid, common FROM x WHERE hit AND eid IN (SELECT eid FROM ok))"""
_OBS = "obs AS (SELECT l_partkey, translate(l_returnflag, 'ANR', 'ACG') AS base, CAST(l_suppkey % 2 AS INTEGER) AS strand, CAST(l_quantity AS INTEGER) AS repeat FROM lineitem)"
_SIDES = """raw AS (SELECT CAST(c_nationkey AS BIGINT) AS bubble, l_suppkey AS member, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R') AS n0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
sides AS (SELECT bubble, member, CASE WHEN n1 * 3 > n0 THEN 1 ELSE 0 END AS side FROM raw),
pm AS (SELECT a.bubble AS a, b.bubble AS b, count(*) FILTER (a.side = 0 AND b.side = 0) AS m00, count(*) FILTER (a.side = 0 AND b.side = 1) AS m01, count(*) FILTER (a.side = 1 AND b.side = 0) AS m10, count(*) FILTER (a.side = 1 AND b.side = 1) AS m11
  FROM sides a JOIN sides b ON a.member = b.member AND a.bubble < b.bubble GROUP BY 1, 2),
mg AS (SELECT *, CAST(m00 + m01 AS DOUBLE) AS r0, CAST(m10 + m11 AS DOUBLE) AS r1, CAST(m00 + m10 AS DOUBLE) AS c0, CAST(m01 + m11 AS DOUBLE) AS c1, CAST(m00 + m01 + m10 + m11 AS DOUBLE) AS n FROM pm)"""


def _db(diagonal: bool) -> str:
    on = [(i, j) for i in (0, 1) for j in (0, 1) if (i == j) == diagonal]
    whole = "nullif(" + " + ".join(f"r{i} * c{j}" for i, j in on) + ", 0)"
    terms = []
    for i in (0, 1):
        for j in (0, 1):
            random = f"(r{i} * c{j} / nullif(n * n, 0))"
            share = f"0.1 * {random}" + (f" + (1 - 0.1) * r{i} * c{j} / {whole}" if (i, j) in on else "")
            terms.append(f"CASE WHEN m{i}{j} > 0 THEN m{i}{j} * 10 * log10(nullif(({share}) / {random}, 0)) ELSE 0 END")
    return "round(CASE WHEN n > 0 THEN " + " + ".join(terms) + " END, 6)"


_SCORES = _SIDES + f""", sc AS (SELECT a, b, m00, m01, m10, m11, {_db(True)} AS log_in, {_db(False)} AS log_out FROM mg),
hy AS (SELECT *, CASE WHEN log_in >= log_out THEN 0 ELSE 1 END AS phase, round(least(greatest(log_in, log_out) - least(log_in, log_out), greatest(log_in, log_out)), 6) AS log_p FROM sc)"""
_JOUR = """ev AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS minute, event_type || ':' || (dayofyear(ts) % 7) AS segment FROM events),
op AS (SELECT *, CASE WHEN lag(segment) OVER w = segment THEN 0 ELSE 1 END AS o FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY minute, event_id)),
ru AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY minute, event_id) - 1 AS idx FROM op),
jo AS (SELECT user_id, CAST(idx AS BIGINT) AS idx, min(segment) AS segment, min(minute) AS first, max(minute) AS last FROM ru GROUP BY 1, 2),
tr AS (SELECT user_id, segment AS s0, lead(segment) OVER w AS s1, last AS last0, lead(first) OVER w AS first1 FROM jo WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
li AS (SELECT s0, s1, count(*) AS coverage, CAST(round(avg(first1 - last0)) AS BIGINT) AS separation FROM tr WHERE s1 IS NOT NULL GROUP BY 1, 2)"""
_MEM = """me AS (SELECT CAST(ascii(event_type) AS BIGINT) AS segment, user_id AS owner, count(*) AS n, CAST(round(avg(event_id)) AS BIGINT) AS off FROM events GROUP BY 1, 2),
po AS (SELECT a.segment AS a, b.segment AS b, count(*) AS common, CAST(round(avg(b.off - a.off)) AS BIGINT) AS off FROM me a JOIN me b ON a.owner = b.owner AND a.segment < b.segment GROUP BY 1, 2)"""
_MODEL = ", ".join(f"({y}, {x}, {p!r}, {q!r})" for y, x, p, q in N.geometric_model())

ORACLES = {
    "marker_edges": f"WITH {_V} SELECT * FROM e",
    "strict_edges": f"WITH {_V} SELECT src, dst, props AS sequence, count(*) AS coverage FROM st WHERE dst IS NOT NULL GROUP BY 1, 2, 3",
    "secondary_edges": f"""WITH {_V}, good AS (SELECT * FROM e WHERE coverage > 1.9 * (SELECT avg(coverage) FROM e)), c AS (SELECT src, dst, count(*) AS coverage FROM st WHERE dst IS NOT NULL AND src <> dst AND src NOT IN (SELECT src FROM good) GROUP BY 1, 2)
SELECT src, dst, coverage FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY coverage DESC, dst) AS k FROM c) WHERE k = 1""",
    "prune_leaves": f"WITH {_V}, p0 AS (SELECT * FROM fw), " + ", ".join(f"p{i + 1} AS (SELECT * FROM p{i} WHERE dst IN (SELECT src FROM p{i}) AND src IN (SELECT dst FROM p{i}))" for i in range(6)) + " SELECT * FROM p6",
    "marker_vertices": "WITH RECURSIVE " + _CHAIN + """, en AS (SELECT r0 * 16777216 + o0 AS a, r1 * 16777216 + o1 AS b FROM chain), sy AS (SELECT a, b FROM en UNION SELECT b, a FROM en),
rc(node, other) AS (SELECT a, a FROM sy UNION SELECT r.node, s.b FROM rc r JOIN sy s ON r.other = s.a), cp AS (SELECT node, min(other) AS vid FROM rc GROUP BY node),
ok AS (SELECT vid FROM cp GROUP BY vid HAVING count(*) BETWEEN 2 AND 100 AND count(DISTINCT node // 16777216) = count(*))
SELECT vid, node // 16777216 AS oriented_id, CAST(node % 16777216 AS INTEGER) AS ordinal FROM cp WHERE vid IN (SELECT vid FROM ok)""",
    "next_vertices": f"WITH {_V} SELECT src, dst, oriented_id, o0, o1 FROM st WHERE o1 - o0 <= 1",
    "intervals_between": f"WITH {_V} SELECT oriented_id, o0, o1 FROM st WHERE src = 101 AND dst = 201",
    "parallel_edges": f"WITH {_SUP} SELECT src, dst, count(*) AS n FROM sup GROUP BY 1, 2 HAVING count(*) > 1",
    "degrees": f"WITH {_V}, {_DEG.format('fw', 'dg')} SELECT node, in_degree, out_degree, coalesce(first_out, -1) AS first_out FROM dg",
    "coverage_histogram": f"WITH {_V} SELECT coverage, count(*) AS n FROM e GROUP BY 1",
    "edge_paths": f"WITH {_V} SELECT oriented_id, CAST(o0 + 1 AS INTEGER) AS step, eid FROM st JOIN fw USING (src, dst)",
    "duplicate_markers": f"WITH {_V} SELECT vid, oriented_id, ordinal, count(*) OVER (PARTITION BY vid, oriented_id) > 1 AS duplicate FROM v",
    "cleanup_duplicates": f"WITH {_V}, d AS (SELECT vid, oriented_id, ordinal, count(*) OVER (PARTITION BY vid, oriented_id) > 1 AS dup FROM v), s AS (SELECT *, avg(CAST(dup AS INTEGER)) OVER (PARTITION BY vid) AS share FROM d) SELECT vid, oriented_id, ordinal FROM s WHERE NOT dup OR share >= 0.5",
    "best_parallel": f"WITH {_SUP} SELECT eid, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY coverage DESC, eid) AS k FROM sup) WHERE k = 1",
    "edit_distance_clusters": """WITH RECURSIVE nr AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey AND levenshtein(x.p_name, y.p_name) < 0.25 * least(length(x.p_name), length(y.p_name))),
rc(node, other) AS (SELECT a, a FROM nr UNION SELECT r.node, s.b FROM rc r JOIN nr s ON r.other = s.a) SELECT p_brand, p_partkey, coalesce((SELECT min(other) FROM rc WHERE node = p_partkey), p_partkey) AS cluster FROM part""",
    "linear_chains": f"WITH {_ORD} SELECT eid, chain, position FROM o",
    "chain_coverage": f"WITH {_ORD}, c AS (SELECT chain, position, lag(coverage) OVER (PARTITION BY chain ORDER BY position) AS k FROM o) SELECT chain, coalesce(min(k), 0) AS min_coverage, round(coalesce(avg(k), 0), 6) AS avg_coverage, coalesce(max(k), 0) AS max_coverage FROM c GROUP BY chain",
    "compressed_edges": f"WITH {_ORD} SELECT chain, min(src) FILTER (position = 0) AS src, arg_max(eid, position) AS dst, count(*) AS length, md5(string_agg(CAST(eid AS VARCHAR), ',' ORDER BY position)) AS path FROM o GROUP BY chain",
    "prune_short_leaves": f"WITH {_ORD} SELECT chain, min(src) FILTER (position = 0) AS src, arg_max(eid, position) AS dst, count(*) AS length FROM o GROUP BY chain HAVING count(*) >= 8",
    "tangle_matrices": f"WITH {_TAN} SELECT eid, in_eid, out_eid, common FROM tm",
    "tangle_solvable": f"WITH {_TAN}, {_SOLVED} SELECT eid, in_eid, out_eid, common FROM sv",
    "detangle": f"""WITH {_TAN}, {_SOLVED}, gone AS (SELECT DISTINCT eid // 100 AS s FROM sv), n AS (SELECT eid, count(*) AS members FROM mem GROUP BY 1)
SELECT CASE WHEN kind = 0 THEN -eid ELSE s * 100 + 51 END AS src, CASE WHEN kind = 0 THEN s * 100 + 50 ELSE -eid END AS dst, members FROM ed JOIN n USING (eid) WHERE s NOT IN (SELECT s FROM gone) UNION ALL
SELECT s * 100 + 50, s * 100 + 51, count(DISTINCT m) FROM mem WHERE s NOT IN (SELECT s FROM gone) GROUP BY s UNION ALL SELECT -in_eid, -out_eid, common FROM sv""",
    "pseudo_paths": """WITH o AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM o) SELECT user_id, CAST(idx AS BIGINT) AS idx, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""",
    "key_segments": f"WITH {_V}, {_DEG.format('fw', 'dg')} SELECT eid AS chain, s.in_degree < 2 AND t.out_degree < 2 AS is_key FROM fw JOIN dg s ON s.node = src JOIN dg t ON t.node = dst",
    "subset_graph": """WITH m AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), z AS (SELECT o, count(*) AS n FROM m GROUP BY 1), c AS (SELECT a.o AS larger, b.o AS smaller, count(*) AS common FROM m a JOIN m b ON a.p = b.p AND a.o <> b.o GROUP BY 1, 2)
SELECT larger, smaller FROM c JOIN z x ON x.o = larger JOIN z y ON y.o = smaller WHERE common = y.n AND y.n < x.n""",
    "merge_parallel": f"WITH {_SUP} SELECT src, dst, string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) AS chains FROM sup GROUP BY 1, 2",
    "observation_coverage": f"WITH {_OBS} SELECT l_partkey, base, strand, repeat, count(*) AS n FROM obs GROUP BY ALL",
    "deduplicate_and_count": f"WITH {_OBS} SELECT base, repeat, count(*) AS n FROM obs GROUP BY 1, 2",
    "most_frequent_base": f"WITH {_OBS}, c AS (SELECT l_partkey, base, count(*) AS n FROM obs GROUP BY 1, 2) SELECT l_partkey, base, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, strpos('ACGT-', base)) AS k FROM c) WHERE k = 1",
    "consensus_modal": f"WITH {_OBS}, c AS (SELECT l_partkey, repeat, count(*) AS n FROM obs GROUP BY 1, 2) SELECT l_partkey, repeat AS called FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, repeat DESC) AS k FROM c) WHERE k = 1",
    "consensus_median": f"""WITH {_OBS}, c AS (SELECT l_partkey, repeat, count(*) AS n FROM obs GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey ORDER BY repeat) AS c, sum(n) OVER (PARTITION BY l_partkey) AS t, coalesce(lag(repeat) OVER (PARTITION BY l_partkey ORDER BY repeat), 0) AS before FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY repeat) AS k FROM r WHERE 2 * c > t) SELECT l_partkey, CAST(CASE WHEN n = 1 THEN ceil((repeat + before) / 2.0) ELSE repeat END AS BIGINT) AS called FROM f WHERE k = 1""",
    "consensus_bayesian": f"""WITH {_OBS}, md(y, x, logp, prior) AS (VALUES {_MODEL}), c AS (SELECT l_partkey, least(greatest(repeat, 1), 20) AS x, count(*) AS n FROM obs GROUP BY 1, 2),
s AS (SELECT l_partkey, y, sum(n * CAST(logp AS DOUBLE)) + min(CAST(prior AS DOUBLE)) AS score FROM c JOIN md ON md.x = c.x GROUP BY 1, 2)
SELECT l_partkey, CAST(y AS BIGINT) AS called FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY round(score, 6) DESC, y) AS k FROM s) WHERE k = 1""",
    "snp_statistics": """WITH p AS (SELECT strpos('ACGT-', translate(l_returnflag, 'ANR', 'ACG')) AS a, strpos('ACGT-', translate(l_linestatus, 'FO', 'CT')) AS b FROM lineitem)
SELECT count(*) FILTER (a <> b AND a % 2 = b % 2) AS transitions, count(*) FILTER (a <> b AND a % 2 <> b % 2) AS transversions FROM p""",
    "gather_bubbles": f"WITH {_SUP} SELECT src, dst, count(*) AS ploidy, min(eid) AS first FROM sup GROUP BY 1, 2 HAVING count(*) >= 2",
    "ploidy_histogram": f"WITH {_SUP} SELECT ploidy, count(*) AS n FROM (SELECT count(*) AS ploidy FROM sup GROUP BY src, dst) GROUP BY 1",
    "weak_branches": f"WITH {_SUP} SELECT eid FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY coverage DESC, eid) AS k FROM sup) WHERE k = 1 OR coverage >= 40",
    "maximum_ploidy": f"WITH {_SUP} SELECT eid FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY coverage DESC, eid) AS k FROM sup) WHERE k <= 2",
    "degenerate_branches": f"WITH {_SUP} SELECT eid FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, l_returnflag ORDER BY coverage DESC, eid) AS k FROM sup) WHERE k = 1",
    "short_loopbacks": f"WITH {_V} SELECT src, dst, coverage FROM e WHERE src <> dst OR coverage >= 3",
    "branch_reads": f"WITH {_SUP} SELECT src, dst, count(DISTINCT l_orderkey) AS reads, min(coverage) AS min_coverage, round(avg(coverage), 6) AS avg_coverage, max(coverage) AS max_coverage FROM sup GROUP BY 1, 2",
    "phasing_matrix": f"WITH {_SIDES} SELECT * FROM pm",
    "phase_scores": f"WITH {_SCORES} SELECT * FROM hy",
    "phasing_edges": f"WITH {_SCORES} SELECT * FROM hy WHERE greatest(m00 + m11, m01 + m10) >= 10 AND least(m00 + m11, m01 + m10) <= 60 AND log_p > -1e6",
    "segment_journeys": f"WITH {_JOUR} SELECT * FROM jo",
    "transitions": f"WITH {_JOUR} SELECT *, first1 - last0 AS gap FROM tr WHERE s1 IS NOT NULL",
    "links": f"WITH {_JOUR} SELECT * FROM li WHERE coverage >= 3",
    "back_segments": f"WITH {_JOUR}, k AS (SELECT s0, s1 FROM li WHERE coverage >= 3 QUALIFY row_number() OVER (PARTITION BY s0 ORDER BY coverage DESC, s1) = 1), o AS (SELECT s0 AS segment, count(*) AS n, min(s1) AS t FROM k GROUP BY 1), i AS (SELECT s1 AS segment, count(*) AS n, min(s0) AS t FROM k GROUP BY 1) SELECT segment FROM o JOIN i USING (segment) WHERE o.n = 1 AND i.n = 1 AND o.t = i.t",
    "segment_members": f"WITH {_MEM} SELECT segment, owner, n, off AS \"offset\" FROM me",
    "pair_offsets": f"WITH {_MEM} SELECT a, b, common, off AS \"offset\" FROM po",
    "segment_pairs": f"""WITH {_MEM}, sp AS (SELECT user_id AS owner, min(event_id) AS f, max(event_id) AS l FROM events GROUP BY 1),
ma AS (SELECT po.a, po.b, me.off + po.off < sp.l AND me.off + po.off + 100 > sp.f AS r FROM po JOIN me ON me.segment = po.a JOIN sp USING (owner) WHERE NOT EXISTS (SELECT 1 FROM me x WHERE x.segment = po.b AND x.owner = me.owner)),
mb AS (SELECT po.a, po.b, me.off - po.off < sp.l AND me.off - po.off + 100 > sp.f AS r FROM po JOIN me ON me.segment = po.b JOIN sp USING (owner) WHERE NOT EXISTS (SELECT 1 FROM me x WHERE x.segment = po.a AND x.owner = me.owner)),
ca AS (SELECT a, b, count(*) FILTER (r) AS u, count(*) FILTER (NOT r) AS s FROM ma GROUP BY 1, 2), cb AS (SELECT a, b, count(*) FILTER (r) AS u, count(*) FILTER (NOT r) AS s FROM mb GROUP BY 1, 2),
j AS (SELECT po.a, po.b, common, coalesce(ca.u, 0) AS ua, coalesce(cb.u, 0) AS ub, coalesce(ca.s, 0) AS sa, coalesce(cb.s, 0) AS sb FROM po LEFT JOIN ca ON ca.a = po.a AND ca.b = po.b LEFT JOIN cb ON cb.a = po.a AND cb.b = po.b)
SELECT a, b, common, ua AS unexplained_a, ub AS unexplained_b, sa AS short_a, sb AS short_b, round(CAST(common AS DOUBLE) / (common + ua + ub), 6) AS jaccard, round(CAST(common AS DOUBLE) / (common + ua + ub + sa + sb), 6) AS raw_jaccard FROM j""",
    "path_graph": f"WITH {_JOUR} SELECT s0 AS u, s1 AS v, count(DISTINCT user_id) AS coverage FROM tr WHERE s1 IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3",
    "fasta_lines": "SELECT '>' || p_partkey || ' length ' || length(s) || chr(10) || s AS value FROM (SELECT p_partkey, upper(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS s FROM part)",
    "gfa_lines": """SELECT 'H' || chr(9) || 'VN:Z:1.0' AS value UNION ALL
SELECT concat_ws(chr(9), 'S', CAST(p_partkey AS VARCHAR), s, 'LN:i:' || length(s), 'RC:i:' || p_size) FROM (SELECT p_partkey, p_size, upper(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS s FROM part) UNION ALL
SELECT DISTINCT concat_ws(chr(9), 'L', CAST(a AS VARCHAR), '+', CAST(b AS VARCHAR), '+', '0M') FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL""",
    "run_length_cigar": """WITH q AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INTEGER)) AS l_linenumber, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) % 7 + 1 AS b FROM lineitem),
ops AS (SELECT l_orderkey, l_linenumber, 0 AS k, least(a, b) AS n, 'M' AS op FROM q UNION ALL SELECT l_orderkey, l_linenumber, 1, abs(a - b), CASE WHEN a > b THEN 'D' ELSE 'I' END FROM q WHERE a <> b),
o AS (SELECT *, CASE WHEN lag(op) OVER w = op THEN 0 ELSE 1 END AS s FROM ops WHERE n > 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, k)),
r AS (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k) AS g FROM o), j AS (SELECT l_orderkey, g, sum(n) AS n, min(op) AS op FROM r GROUP BY 1, 2)
SELECT l_orderkey, string_agg(n || op, '' ORDER BY g) AS cigar FROM j GROUP BY 1""",
    "read_summary": "SELECT doc_id AS read_id, n_chars, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS labels, (SELECT count(*) FROM conversations c WHERE c.conv_id = d.doc_id) AS turns FROM documents d",
    "summary_json": """SELECT '{"documents":{"n":' || (SELECT count(*) FROM documents) || ',"chars":' || (SELECT sum(n_chars) FROM documents) || '},"orders":{"n":' || (SELECT count(*) FROM orders) || '}}' AS json""",
}
ORACLES["split_clusters"] = f"""WITH cl AS ({ORACLES['edit_distance_clusters']}), z AS (SELECT p_brand, cluster, count(*) AS coverage FROM cl GROUP BY 1, 2)
SELECT p_brand, cluster, coverage FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY coverage DESC, cluster) AS k FROM z) WHERE k = 1 OR coverage >= 2"""
ORACLES["induced_alignment"] = f"WITH vx AS ({ORACLES['marker_vertices']}) SELECT a.oriented_id AS r0, b.oriented_id AS r1, a.ordinal AS o0, b.ordinal AS o1 FROM vx a JOIN vx b ON a.vid = b.vid AND a.oriented_id < b.oriented_id"
