"""Queries of lookups, vertex upkeep and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import lookups as P
from weftgraph.operators import marker_graph as G
from weftgraph.operators.graph import connected_components
from weftgraph.plans.common import WORDS, table
from weftgraph.plans.graphs import _ORD, _V, _all_edges, _edges, _forward, _orders, _vertices
from weftgraph.plans.overlaps import _CHAIN, _INFO, _chains, _long, _words, alignment_metrics
from weftgraph.storage import materialize

#: The read and the name that the lookups ask for.
READ, NAME = 10, "Brand#11"


def _kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as k-mers, with as many repeats as the type has letters."""
    named = table(spark, sf_dir, "events").select("event_id", "event_type")
    order = _vertices(spark, sf_dir).select("oriented_id", "ordinal", "vid")
    code = named.select(F.ascii("event_type").alias("c"), "event_type").distinct()
    return order.join(code.select((F.col("c") % 100).alias("c"), F.col("event_type").alias("kmer")), F.col("vid") % 100 == F.col("c")).select("oriented_id", "ordinal", "kmer")


def connectivity(spark, sf_dir):
    chains = materialize(_chains(spark, sf_dir), "chains")
    first = chains.select("r0", "o0").orderBy("r0", "o0").limit(1).collect()  # the marker that is asked for
    return G.marker_connectivity(chains, *(first[0] if first else (0, 0)))


def reads_by_segment(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    path = items.select(F.col("l_suppkey").alias("segment"), F.col("l_partkey").alias("eid")).distinct()
    return P.reads_by_segment(path, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("eid"), F.col("p_size").alias("oriented_id")))


def edge_coverage_data(spark, sf_dir):
    return G.edge_coverage_data(_edges(spark, sf_dir), _vertices(spark, sf_dir).select("oriented_id", F.col("ordinal").alias("o0"), F.col("props").alias("sequence")))


QUERIES = {
    "reads_by_name": lambda s, d: P.reads_by_name(table(s, d, "part"), NAME, "p_brand").select("p_partkey", "p_brand"),
    "markers_of_read": lambda s, d: _long(P.markers_of_read(_words(s, d), READ).select("oriented_id", "ordinal", "kmer")),
    "oriented_alignments": lambda s, d: _long(P.oriented_alignments(alignment_metrics(s, d).select("r0", "r1", "n0", "n1", "first0", "first1", "last0", "last1", "markers"))),
    "aligned_markers": lambda s, d: _long(P.aligned_markers(materialize(_chains(s, d), "chains"))),
    "aligned_coverage": lambda s, d: _long(P.aligned_coverage(materialize(_chains(s, d), "chains"))),
    "marker_connectivity": lambda s, d: _long(connectivity(s, d)),
    "related_edges": lambda s, d: P.related_edges(table(s, d, "lineitem"), "l_suppkey", "l_partkey"),
    "disconnecting_edges": lambda s, d: G.disconnecting_edges(_forward(s, d), 1),
    "renumber": lambda s, d: G.renumber(_vertices(s, d).drop("props")),
    "remove_vertices": lambda s, d: G.remove_vertices(v := _vertices(s, d).drop("props"), G.bad_vertices(v).where("4 * duplicate_coverage > coverage")),
    "bad_vertices": lambda s, d: G.bad_vertices(_vertices(s, d).drop("props")),
    "coverage_by_kmer": lambda s, d: G.coverage_by_kmer(_vertices(s, d).drop("props"), _kmers(s, d)),
    "edge_coverage_data": edge_coverage_data,
    "force_flags": lambda s, d: G.force_flags(_all_edges(s, d), removed=False),
    "reads_by_segment": reads_by_segment,
    "component_sizes": lambda s, d: P.component_sizes(connected_components(_orders(s, d), "src", "dst")),
}

_DUP = f"WITH {_V}, d AS (SELECT vid, oriented_id, ordinal, count(*) OVER (PARTITION BY vid, oriented_id) > 1 AS dup FROM v), b AS (SELECT vid, count(*) AS coverage, count(*) FILTER (dup) AS duplicate_coverage, min(row(oriented_id, ordinal)) AS m FROM d GROUP BY 1)"
_BOTH_ENDS = "WITH " + _CHAIN + ", am AS (SELECT r0 AS oriented_id, o0 AS ordinal, r1 AS other, o1 AS other_ordinal FROM chain UNION ALL SELECT r1, o1, r0, o0 FROM chain)"

ORACLES = {
    "reads_by_name": f"SELECT p_partkey, p_brand FROM part WHERE p_brand = '{NAME}'",
    "markers_of_read": f"WITH {WORDS} SELECT oriented_id, ordinal, kmer FROM words WHERE oriented_id = {READ}",
    "oriented_alignments": f"WITH {_INFO} SELECT r0 AS oriented_id, r1 AS other, n0, n1, first0, first1, last0, last1, markers FROM info UNION ALL SELECT r1, r0, n1, n0, first1, first0, last1, last0, markers FROM info",
    "aligned_markers": _BOTH_ENDS + " SELECT * FROM am",
    "aligned_coverage": _BOTH_ENDS + " SELECT oriented_id, ordinal, count(*) AS n FROM am GROUP BY 1, 2",
    "marker_connectivity": "WITH RECURSIVE " + _CHAIN + """, en AS (SELECT r0 * 16777216 + o0 AS a, r1 * 16777216 + o1 AS b FROM chain), sy AS (SELECT a, b FROM en UNION SELECT b, a FROM en),
rc(node) AS (SELECT min(a) FROM en UNION SELECT s.b FROM rc JOIN sy s ON rc.node = s.a) SELECT DISTINCT r0, o0, r1, o1 FROM chain WHERE r0 * 16777216 + o0 IN (SELECT node FROM rc)""",
    "related_edges": "WITH m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT DISTINCT a.l_suppkey, b.l_suppkey AS related FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey",
    "disconnecting_edges": f"""WITH {_V}, ad AS (SELECT eid AS by, src AS x, dst AS y FROM fw UNION ALL SELECT eid, dst, src FROM fw),
way AS (SELECT fw.eid FROM fw JOIN ad ON ad.x = fw.src AND ad.y = fw.dst AND ad.by <> fw.eid UNION SELECT fw.eid FROM fw JOIN ad p ON p.x = fw.src AND p.by <> fw.eid JOIN ad q ON q.x = p.y AND q.y = fw.dst AND q.by <> fw.eid)
SELECT eid FROM fw WHERE eid NOT IN (SELECT eid FROM way)""",
    "renumber": f"WITH {_V} SELECT dense_rank() OVER (ORDER BY vid) - 1 AS vid, oriented_id, ordinal FROM v",
    "remove_vertices": _DUP + " SELECT vid, oriented_id, ordinal FROM v WHERE vid NOT IN (SELECT vid FROM b WHERE 4 * duplicate_coverage > coverage)",
    "bad_vertices": _DUP + ", f AS (SELECT vid, oriented_id, ordinal FROM v QUALIFY row_number() OVER (PARTITION BY vid ORDER BY oriented_id, ordinal) = 1) SELECT vid, oriented_id, ordinal, coverage, duplicate_coverage FROM b JOIN f USING (vid) WHERE duplicate_coverage > 0",
    "coverage_by_kmer": f"WITH {_V}, c AS (SELECT vid, count(*) AS coverage FROM v GROUP BY 1), t AS (SELECT DISTINCT event_type, ascii(event_type) % 100 AS c FROM events) SELECT event_type AS kmer, coverage, count(*) AS n FROM c JOIN t ON t.c = vid % 100 GROUP BY 1, 2",
    "edge_coverage_data": f"WITH {_V} SELECT src, dst, props AS sequence, count(*) AS n FROM st WHERE dst IS NOT NULL GROUP BY 1, 2, 3",
    "force_flags": f"WITH {_V} SELECT src * 100000 + dst AS eid, src, dst, coverage, false AS removed FROM e",
    "reads_by_segment": """WITH p AS (SELECT DISTINCT l_suppkey AS segment, l_partkey AS eid FROM lineitem), o AS (SELECT segment, p_size AS oriented_id, count(*) AS n FROM p JOIN part ON p_partkey = eid GROUP BY 1, 2)
SELECT segment, (SELECT count(*) FROM p WHERE p.segment = o.segment) AS edges, count(*) OVER (PARTITION BY segment) AS reads, oriented_id, n FROM o""",
    "component_sizes": f"WITH {_ORD}, c AS (SELECT chain, count(*) + 1 AS size FROM o GROUP BY 1) SELECT size, count(*) AS n FROM c GROUP BY 1",
}
