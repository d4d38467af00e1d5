"""Queries on candidates, alignments and the read graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import alignment as A
from weftgraph.operators import lowhash as L
from weftgraph.operators import read_graph as R
from weftgraph.operators.graph import connected_components
from weftgraph.plans.common import WORDS, table
from weftgraph.storage import materialize

OPTIONS = L.LowHashOptions(hash_fraction=0.02, iterations=10, max_bucket=10, min_frequency=2)
TRIM, TOP, P = 30, 2, 0.1


def _words(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    docs = table(spark, sf_dir, name)
    return L.word_markers(docs if name == "documents" else docs.withColumnRenamed("item_id", "doc_id"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.word_features(table(spark, sf_dir, "documents"), OPTIONS.m)


def candidates(spark, sf_dir):
    return L.candidates(L.word_texts(table(spark, sf_dir, "documents")), OPTIONS)


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.word_sequences(table(spark, sf_dir, "documents"))


def _chains(spark, sf_dir):
    return A.matched_markers(candidates(spark, sf_dir), _sequences(spark, sf_dir), 1, chain=True)


def alignment_metrics(spark, sf_dir):
    return A.alignment_metrics(A.matched_markers(candidates(spark, sf_dir), _sequences(spark, sf_dir), 1, chain=True, summed=True))


def _long(df: DataFrame) -> DataFrame:
    """Counts and ordinals as longs."""
    return df.select(*(F.col(c).cast("long") if kind == "int" else F.col(c) for c, kind in df.dtypes))


def _info(spark, sf_dir):
    info = alignment_metrics(spark, sf_dir)
    return materialize(info.withColumns({"aid": F.col("r0") * (1 << 32) + F.col("r1"), "u": F.col("r0"), "v": F.col("r1"), "trim": F.greatest("left_trim", "right_trim")}), "info")


def _edges(spark, sf_dir):
    return _info(spark, sf_dir).select("aid", "u", "v", "markers")


def streak_round_trip(spark, sf_dir):
    back = A.from_streaks(A.streaks(_chains(spark, sf_dir)))
    return back.groupBy("r0", "r1").agg(F.count("*").alias("n"), F.sum(F.col("o0").cast("long") * F.col("o1")).cast("long").alias("checksum"))


def component_summary(spark, sf_dir):
    return R.component_summary(R.components(candidates(spark, sf_dir).select(F.col("r0").alias("u"), F.col("r1").alias("v"))))


def _pairs(spark, sf_dir):
    return materialize(candidates(spark, sf_dir).select(F.col("r0").alias("u"), F.col("r1").alias("v")), "pairs")


def aligned(method: int):
    def run(spark, sf_dir):
        options = A.AlignOptions(method=method)
        found = A.compute_alignments(candidates(spark, sf_dir), _sequences(spark, sf_dir), options, summed=True)
        return A.alignment_metrics(found)

    return run


def chimeric(spark, sf_dir):
    return R.chimeric(_pairs(spark, sf_dir))


def strand_separation(spark, sf_dir):
    info = _info(spark, sf_dir).select("aid", "r0", "r1", "markers").withColumn("same_strand", F.col("aid") % 7 != 0)
    edges = R.oriented_edges(info).join(info.select("aid", "markers"), "aid")
    return R.separate_strands(edges)


def inconsistent(spark, sf_dir):
    edges = _info(spark, sf_dir).select("u", "v", F.col("avg_offset").alias("offset"))
    return R.inconsistent(edges, most=20.0)


QUERIES = {
    "lowhash_candidates": candidates,
    "lowhash_bucket_histogram": lambda s, d: L.bucket_histogram(_features(s, d), OPTIONS),
    "lowhash_read_statistics": lambda s, d: L.read_statistics(_features(s, d), OPTIONS),
    "lowhash_features": lambda s, d: L.common_features(_features(s, d), OPTIONS),
    "lowhash_until": lambda s, d: L.candidates_until(_features(s, d), table(s, d, "documents").count(), L.LowHashOptions(hash_fraction=0.02)),
    "candidate_table": lambda s, d: L.candidate_table(candidates(s, d), stranded=False).select("oriented_id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others")),
    "candidates_oriented": lambda s, d: L.symmetric_view(candidates(s, d)),
    "all_pairs": lambda s, d: L.all_pairs(table(s, d, "nation"), "n_nationkey"),
    "contamination_candidates": lambda s, d: L.cross_candidates(_features(s, d), _words(s, d, "benchmark"), 4, 2).select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "hits"),
    "common_members": lambda s, d: L.common_members(table(s, d, "lineitem"), "l_suppkey", "l_partkey"),
    "alignment_metrics": lambda s, d: _long(alignment_metrics(s, d)),
    "alignment_classify": lambda s, d: A.classify(alignment_metrics(s, d), TRIM).select("r0", "r1", "kind"),
    "alignment_filter": lambda s, d: A.filter_alignments(alignment_metrics(s, d), A.AlignOptions(min_aligned_markers=5, max_trim=200)).select("r0", "r1", "markers"),
    "alignment_streaks": lambda s, d: A.streaks(_chains(s, d)),
    "alignment_streaks_round_trip": streak_round_trip,
    "alignment_matrix": lambda s, d: A.alignment_matrix(A.matched_markers(candidates(s, d), _sequences(s, d), 1), 50),
    "alignment_swapped": lambda s, d: _long(A.alignment_metrics(A.swapped(_chains(s, d))).select("r0", "r1", "first0", "last0", "first1", "last1")),
    "align_shortest_path": aligned(0), "align_global": aligned(1), "align_downsampled": aligned(3), "align_cells": aligned(4),
    "read_graph_topk": lambda s, d: R.top_k_edges(_edges(s, d), TOP),
    "read_graph_isolated": lambda s, d: R.isolated(table(s, d, "documents").select("doc_id"), _edges(s, d).select("u", "v"), "doc_id"),
    "adaptive_criteria": lambda s, d: R.adaptive_criteria(_info(s, d), P),
    "criteria_filter": lambda s, d: R.meets_criteria(i := _info(s, d), R.adaptive_criteria(i, P)).select("r0", "r1"),
    "read_graph_adaptive": lambda s, d: R.read_graph(_info(s, d), TOP, P).select("aid"),
    "connected_components": lambda s, d: connected_components(_pairs(s, d), "u", "v"),
    "component_summary": component_summary,
    "triangles": lambda s, d: R.triangles(_pairs(s, d)),
    "edge_neighbourhoods": lambda s, d: R.edge_neighbourhoods(_pairs(s, d)),
    "within_hops": lambda s, d: R.within_hops(_pairs(s, d).select(F.col("u").alias("node")).distinct(), _pairs(s, d), 2),
    "label_propagation": lambda s, d: R.label_propagation(_pairs(s, d)),
    "chimera_flags": chimeric,
    "bridges": lambda s, d: R.bridges(_pairs(s, d)),
    "strand_separation": strand_separation,
    "inconsistent_alignments": inconsistent,
}

_LOW = WORDS + f""", grams AS (
  SELECT oriented_id, ordinal, kmer || ' ' || lead(kmer, 1) OVER w || ' ' || lead(kmer, 2) OVER w || ' ' || lead(kmer, 3) OVER w AS feature FROM words WINDOW w AS (PARTITION BY oriented_id ORDER BY ordinal)
),
low AS (
  SELECT CAST(iteration AS INTEGER) AS iteration, oriented_id, ordinal, feature, hash
  FROM (SELECT *, CAST('0x' || substr(d, 1, 15) AS BIGINT) AS hash, CAST('0x' || substr(d, 1, 13) AS BIGINT) AS h, CAST('0x' || substr(d, 14, 13) AS BIGINT) AS g FROM (SELECT *, md5(feature) AS d FROM grams WHERE feature IS NOT NULL)),
    range({OPTIONS.iterations}) t(iteration)
  WHERE (h + iteration * g) % {L.DRAWS} < {int(OPTIONS.hash_fraction * L.DRAWS)}
),
sizes AS (SELECT iteration, hash, count(*) AS size FROM low GROUP BY 1, 2)"""
_CAND = _LOW + f""", used AS (SELECT low.* FROM low JOIN sizes USING (iteration, hash) WHERE size BETWEEN 2 AND {OPTIONS.max_bucket}),
cand AS (
  SELECT a.oriented_id AS r0, b.oriented_id AS r1, true AS same_strand, count(*) AS hits FROM used a JOIN used b ON a.iteration = b.iteration AND a.hash = b.hash AND a.oriented_id < b.oriented_id
  GROUP BY 1, 2 HAVING count(*) >= {OPTIONS.min_frequency}
)"""
_COMMON = _CAND + """, once AS (
  SELECT oriented_id, kmer, min(ordinal) AS ordinal FROM words GROUP BY 1, 2 HAVING count(*) = 1
), lens AS (SELECT oriented_id, count(*) AS n FROM words GROUP BY 1),
common AS (
  SELECT r0, r1, a.ordinal AS o0, b.ordinal AS o1, la.n AS n0, lb.n AS n1 FROM cand JOIN once a ON a.oriented_id = r0 JOIN once b ON b.oriented_id = r1 AND a.kmer = b.kmer
  JOIN lens la ON la.oriented_id = r0 JOIN lens lb ON lb.oriented_id = r1
)"""
_CHAIN = _COMMON + """, chain AS (
  SELECT r0, r1, o0, o1, n0, n1 FROM (SELECT *, max(o1) OVER (PARTITION BY r0, r1 ORDER BY o0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM common) WHERE top IS NULL OR o1 > top
), steps AS (
  SELECT *, o0 - lag(o0) OVER w AS d0, o1 - lag(o1) OVER w AS d1 FROM chain WINDOW w AS (PARTITION BY r0, r1 ORDER BY o0)
)"""
_INFO = _CHAIN + """, base AS (
  SELECT r0, r1, count(*) AS markers, min(n0) AS n0, min(n1) AS n1, min(o0) AS first0, max(o0) AS last0, min(o1) AS first1, max(o1) AS last1, min(o0 - o1) AS min_offset, max(o0 - o1) AS max_offset,
    sum(o0 - o1) AS s, coalesce(max(greatest(d0, d1)), 0) AS max_skip, coalesce(max(abs(d0 - d1)), 0) AS max_drift FROM steps GROUP BY r0, r1
), info AS (
  SELECT r0, r1, markers, n0, n1, first0, last0, first1, last1, min_offset, max_offset, max_skip, max_drift, round(CAST(s AS DOUBLE) / markers, 6) AS avg_offset,
    round(least(CAST(markers AS DOUBLE) / (last0 - first0 + 1), CAST(markers AS DOUBLE) / (last1 - first1 + 1)), 6) AS fraction, least(first0, first1) AS left_trim, least(n0 - 1 - last0, n1 - 1 - last1) AS right_trim,
    CAST((n1 - first1 - last1) - (n0 - first0 - last0) AS DOUBLE) / 2 AS center_offset,
    round((CAST(last0 - first0 + last1 - first1 + 2 AS DOUBLE) / 2) / (n0 + n1 - CAST(last0 - first0 + last1 - first1 + 2 AS DOUBLE) / 2), 6) AS jaccard
  FROM base
)"""
_TOPK = """, ends AS (SELECT r0 * 4294967296 + r1 AS aid, r0 AS u, r1 AS v, markers, r0 AS node FROM {0} UNION ALL SELECT r0 * 4294967296 + r1, r0, r1, markers, r1 FROM {0}),
best AS (SELECT DISTINCT aid, u, v, markers FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY markers DESC, aid DESC) AS k FROM ends) WHERE k <= {1})"""


def _percentile(column: str, large: bool, high: float, bins: int, p: float) -> str:
    width = high / bins
    return f"""(SELECT round(0.0 + (min(bin) + 0.5) * {width!r}, 6) FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM
  (SELECT CAST(floor((x.{column} - 0.0) / {width!r}) AS BIGINT) AS bin, count(*) AS n FROM crit x WHERE x.{column} >= 0.0 AND x.{column} < {high!r} GROUP BY 1)) WHERE CAST(c AS DOUBLE) / t >= {p!r}) AS {column}"""


_CRIT = _INFO + ", crit AS (SELECT *, greatest(left_trim, right_trim) AS trim FROM info), limits AS (SELECT " + ", ".join(_percentile(n, g, h, b, P if g else 1 - P) for n, (g, _, h, b) in R.CRITERIA.items()) + ")"
_MEETS = _CRIT + ", meets AS (SELECT crit.* FROM crit, limits WHERE " + " AND ".join(f"crit.{n} {'>=' if g else '<='} limits.{n}" for n, (g, *_x) in R.CRITERIA.items()) + ")"
_REACH = """, sym AS (SELECT r0 AS a, r1 AS b FROM cand UNION SELECT r1, r0 FROM cand),
reach(node, other) AS (SELECT a, a FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON r.other = s.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
_SYM = _CAND + ", sym AS (SELECT r0 AS a, r1 AS b FROM cand UNION SELECT r1, r0 FROM cand)"

ORACLES = {
    "lowhash_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "lowhash_bucket_histogram": f"WITH {_LOW} SELECT iteration, size, count(*) AS buckets, CAST(sum(size) AS BIGINT) AS entries FROM sizes GROUP BY 1, 2",
    "lowhash_read_statistics": f"WITH {_LOW} SELECT oriented_id, count(*) FILTER (size < 2) AS sparse, count(*) FILTER (size BETWEEN 2 AND 10) AS good, count(*) FILTER (size > 10) AS crowded FROM low JOIN sizes USING (iteration, hash) GROUP BY 1",
    "lowhash_features": f"""WITH {_LOW}, fs AS (SELECT iteration, feature, count(*) AS size FROM low GROUP BY 1, 2), fu AS (SELECT low.* FROM low JOIN fs USING (iteration, feature) WHERE size BETWEEN 2 AND 10),
fp AS (SELECT DISTINCT a.oriented_id AS r0, b.oriented_id AS r1, true AS same_strand, CAST(a.ordinal AS INTEGER) AS o0, CAST(b.ordinal AS INTEGER) AS o1 FROM fu a JOIN fu b ON a.iteration = b.iteration AND a.feature = b.feature AND a.oriented_id < b.oriented_id)
SELECT fp.*, features FROM fp JOIN (SELECT r0, r1, count(*) AS features FROM fp GROUP BY 1, 2 HAVING count(*) >= 2) USING (r0, r1)""",
    "candidate_table": f"WITH {_SYM} SELECT a AS oriented_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS others FROM sym GROUP BY 1",
    "candidates_oriented": f"WITH {_CAND} SELECT r0 * 2 + s AS oriented_id, r1 * 2 + s AS other, hits FROM cand, range(2) t(s) UNION ALL SELECT r1 * 2 + s, r0 * 2 + s, hits FROM cand, range(2) t(s)",
    "all_pairs": "SELECT a.n_nationkey AS r0, b.n_nationkey AS r1, s AS same_strand FROM nation a, nation b, (VALUES (true), (false)) t(s) WHERE a.n_nationkey < b.n_nationkey",
    "contamination_candidates": r"""WITH """ + WORDS + r""", bwords AS (
  SELECT item_id, unnest(w) AS kmer, unnest(range(len(w))) AS ordinal FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM benchmark)
), g AS (SELECT DISTINCT oriented_id AS doc_id, kmer || ' ' || lead(kmer, 1) OVER w || ' ' || lead(kmer, 2) OVER w || ' ' || lead(kmer, 3) OVER w AS f FROM words WINDOW w AS (PARTITION BY oriented_id ORDER BY ordinal)),
b AS (SELECT DISTINCT item_id, kmer || ' ' || lead(kmer, 1) OVER w || ' ' || lead(kmer, 2) OVER w || ' ' || lead(kmer, 3) OVER w AS f FROM bwords WINDOW w AS (PARTITION BY item_id ORDER BY ordinal))
SELECT doc_id, item_id, count(*) AS hits FROM g JOIN b USING (f) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "common_members": "WITH m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS common FROM m x JOIN m y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2",
    "alignment_metrics": f"WITH {_INFO} SELECT * FROM info",
    "alignment_classify": f"""WITH {_INFO}, t AS (SELECT r0, r1, first0 AS l0, first1 AS l1, n0 - 1 - last0 AS q0, n1 - 1 - last1 AS q1 FROM info)
SELECT r0, r1, CASE WHEN l0 <= {TRIM} AND q0 <= {TRIM} AND l1 <= {TRIM} AND q1 <= {TRIM} THEN 'ambiguous' WHEN l0 <= {TRIM} AND q0 <= {TRIM} THEN 'contained0' WHEN l1 <= {TRIM} AND q1 <= {TRIM} THEN 'contained1'
  WHEN l0 > {TRIM} AND q0 <= {TRIM} AND l1 <= {TRIM} AND q1 >= {TRIM} THEN 'backward0' WHEN l1 > {TRIM} AND q1 <= {TRIM} AND l0 <= {TRIM} AND q0 >= {TRIM} THEN 'backward1' ELSE 'ambiguous' END AS kind FROM t""",
    "alignment_filter": f"WITH {_INFO} SELECT r0, r1, markers FROM info WHERE markers >= 5 AND fraction >= 0 AND left_trim <= 200 AND right_trim <= 200 AND max_skip <= 30 AND max_drift <= 30",
    "alignment_streaks": f"""WITH {_CHAIN}, o AS (SELECT *, sum(CASE WHEN d0 = 1 AND d1 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY r0, r1 ORDER BY o0) - 1 AS idx FROM steps),
s AS (SELECT r0, r1, idx, min(o0) AS a0, min(o1) AS a1, max(o0) AS b0, max(o1) AS b1, count(*) AS n FROM o GROUP BY 1, 2, 3)
SELECT r0, r1, CAST(idx AS INTEGER) AS idx, CAST(a0 - coalesce(lag(b0) OVER w, 0) AS INTEGER) AS skip0, CAST(a1 - coalesce(lag(b1) OVER w, 0) AS INTEGER) AS skip1, n FROM s WINDOW w AS (PARTITION BY r0, r1 ORDER BY idx)""",
    "alignment_streaks_round_trip": f"WITH {_CHAIN} SELECT r0, r1, count(*) AS n, CAST(sum(o0 * o1) AS BIGINT) AS checksum FROM chain GROUP BY 1, 2",
    "alignment_matrix": f"WITH {_COMMON} SELECT r0, r1, CAST(floor((o0 - o1) / 50.0) * 50 AS BIGINT) AS \"offset\", count(*) AS n FROM common GROUP BY 1, 2, 3",
    "alignment_swapped": f"WITH {_INFO} SELECT r1 AS r0, r0 AS r1, first1 AS first0, last1 AS last0, first0 AS first1, last0 AS last1 FROM info",
    "read_graph_topk": f"WITH {_INFO}" + _TOPK.format("info", TOP) + " SELECT * FROM best",
    "read_graph_isolated": f"WITH {_INFO} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT r0 FROM info UNION SELECT r1 FROM info)",
    "adaptive_criteria": f"WITH {_CRIT} SELECT * FROM limits",
    "criteria_filter": f"WITH {_MEETS} SELECT r0, r1 FROM meets",
    "read_graph_adaptive": f"WITH {_MEETS}" + _TOPK.format("meets", TOP) + " SELECT aid FROM best",
    "connected_components": f"WITH RECURSIVE {_CAND}{_REACH} SELECT * FROM comp",
    "component_summary": f"WITH RECURSIVE {_CAND}{_REACH}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1) SELECT component, size, CAST(row_number() OVER w AS INTEGER) AS rank, CAST(sum(size) OVER w AS BIGINT) AS cumulative FROM z WINDOW w AS (ORDER BY size DESC, component)",
    "triangles": f"WITH {_CAND} SELECT x.r0 AS a, x.r1 AS b, y.r1 AS c FROM cand x JOIN cand y ON x.r1 = y.r0 JOIN cand z ON z.r0 = x.r0 AND z.r1 = y.r1",
    "edge_neighbourhoods": f"""WITH {_SYM}, e AS (SELECT r0 AS u, r1 AS v FROM cand),
cu AS (SELECT u, v, s.b AS x, (EXISTS (SELECT 1 FROM sym t WHERE t.a = v AND t.b = s.b)) AS both_ FROM e JOIN sym s ON s.a = u WHERE s.b <> v),
cv AS (SELECT u, v, s.b AS x, (EXISTS (SELECT 1 FROM sym t WHERE t.a = u AND t.b = s.b)) AS both_ FROM e JOIN sym s ON s.a = v WHERE s.b <> u)
SELECT u, v, (SELECT count(*) FROM cu WHERE cu.u = e.u AND cu.v = e.v AND both_) AS common, (SELECT count(*) FROM cu WHERE cu.u = e.u AND cu.v = e.v AND NOT both_) AS only_u,
  (SELECT count(*) FROM cv WHERE cv.u = e.u AND cv.v = e.v AND NOT both_) AS only_v,
  (SELECT count(*) FROM cu JOIN cv ON cu.u = cv.u AND cu.v = cv.v JOIN sym s ON s.a = cu.x AND s.b = cv.x WHERE cu.u = e.u AND cu.v = e.v AND NOT cu.both_ AND NOT cv.both_) AS between FROM e""",
    "within_hops": f"""WITH {_SYM}, st AS (SELECT DISTINCT r0 AS start FROM cand), h AS (SELECT start, start AS node, 0 AS distance FROM st UNION ALL SELECT start, b, 1 FROM st JOIN sym ON a = start
  UNION ALL SELECT start, t.b, 2 FROM st JOIN sym s ON s.a = start JOIN sym t ON t.a = s.b) SELECT start, node, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY 1, 2""",
}
ORACLES["edge_neighbourhoods"] = ORACLES["edge_neighbourhoods"].replace("AS between FROM", 'AS "between" FROM')
