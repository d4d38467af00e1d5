"""Queries of superbubbles and snippet clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import snippets as S
from weftgraph.operators import superbubbles as D
from weftgraph.plans.common import table
from weftgraph.plans.walks import _GROUND, _listed, _visits


def _shipments(spark, sf_dir) -> DataFrame:
    """Every part a superbubble: its line items by return flag are ways through the quarters they are shipped in, from one gate to another."""
    quarter = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    by = Window.partitionBy("l_partkey", "l_returnflag").orderBy("number")
    whole = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("number", F.row_number().over(whole)).select("l_partkey", "l_returnflag", "number", quarter.alias("q"), F.col("l_quantity").cast("long").alias("coverage"))
    node = lambda q: (F.col("l_partkey") * 100_000 + q).cast("long")
    last = F.lead("q").over(by).isNull()
    eid = (F.col("l_partkey") * 100_000 + F.col("number")) * 4
    steps = items.select(
        "l_partkey", "coverage", eid.alias("eid"), node(F.coalesce(F.lag("q").over(by), F.lit(1))).alias("src"), node(F.col("q")).alias("dst"), last.alias("last"), F.lit(True).alias("inner")
    ).withColumn("length", F.lit(1).cast("long"))
    steps = steps.where("src != dst or last")
    ends = steps.where("last").select("l_partkey", "coverage", (F.col("eid") + 1).alias("eid"), F.col("dst").alias("src"), node(F.lit(99_999)).alias("dst"), "last", "inner", "length")
    gates = items.select("l_partkey").distinct().select("l_partkey", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).select(
        "l_partkey", F.lit(1).cast("long").alias("coverage"), (-F.col("l_partkey") * 4 - F.col("k")).cast("long").alias("eid"),
        F.when(F.col("k") == 2, -F.col("l_partkey") - 1).otherwise(node(F.lit(99_999))).cast("long").alias("src"), F.when(F.col("k") == 2, node(F.lit(1))).otherwise(-F.col("l_partkey") - 1).cast("long").alias("dst"),
        F.lit(False).alias("last"), F.lit(False).alias("inner"), F.lit(1).cast("long").alias("length"),
    )
    return steps.where("src != dst").unionByName(ends).unionByName(gates).select("eid", "src", "dst", "coverage", "length", "inner")


def superbubbles(spark, sf_dir):
    return D.resolve_superbubbles(_shipments(spark, sf_dir)).select("src", "dst", "kind", _listed("path"))


def superbubble_verdicts(spark, sf_dir):
    return D.superbubbles(_shipments(spark, sf_dir)).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("nodes").alias("nodes"))


def snippet_clusters(spark, sf_dir):
    visits = _visits(spark, sf_dir)
    three_days = F.floor(F.col("segment") / 300).alias("subgraph")
    parts = S.journey_snippets(visits, visits.select(three_days, "segment").distinct())
    return S.cluster_segments(S.snippet_clusters(parts)).select("subgraph", _listed("top"), "segment", "coverage")


QUERIES = {"superbubbles": superbubbles, "superbubble_verdicts": superbubble_verdicts, "snippet_clusters": snippet_clusters}

ORACLES = {
    "superbubble_verdicts": """WITH i AS (SELECT l_partkey, l_returnflag, l_shipdate, l_orderkey, l_linenumber, year(l_shipdate) * 4 + quarter(l_shipdate) AS q FROM lineitem),
s AS (SELECT l_partkey AS p, coalesce(lag(q) OVER w, 1) AS a, q AS b, lead(q) OVER w IS NULL AS z FROM i WINDOW w AS (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber)),
e AS (SELECT p, a, b FROM s WHERE a <> b UNION ALL SELECT p, b, 99999 FROM s WHERE z),
n AS (SELECT p, x, sum(o) AS o, sum(i) AS i FROM (SELECT p, a AS x, 1 AS o, 0 AS i FROM e UNION ALL SELECT p, b, 0, 1 FROM e) GROUP BY 1, 2),
c AS (SELECT p, count(*) AS nodes FROM n GROUP BY 1 HAVING max(o) > 1 OR max(i) > 1)
SELECT CASE WHEN nodes > 50 THEN 'too many nodes' ELSE 'ready' END AS verdict, count(*) AS n, CAST(sum(nodes) AS BIGINT) AS nodes FROM c GROUP BY 1""",
    "snippet_clusters": f"""WITH RECURSIVE {_GROUND},
v AS (SELECT segment // 300 AS g, owner, segment, idx - row_number() OVER (PARTITION BY segment // 300, owner ORDER BY idx) AS run, idx FROM jo),
sn AS (SELECT g, owner, list(segment ORDER BY idx) AS segs, list_sort(list_distinct(list(segment))) AS mem FROM v GROUP BY g, owner, run),
st AS (SELECT g, mem, row_number() OVER (ORDER BY g, mem) AS id FROM (SELECT DISTINCT g, mem FROM sn)),
ho AS (SELECT x.id AS u, y.id AS v FROM st x JOIN st y ON x.g = y.g AND x.id <> y.id AND len(list_filter(y.mem, lambda m: NOT list_contains(x.mem, m))) <= round(0.05 * len(y.mem))),
re AS (SELECT u, v FROM ho UNION SELECT re.u, ho.v FROM re JOIN ho ON re.v = ho.u),
pa AS (SELECT id, least(id, coalesce(min(m.v), id)) AS part FROM st LEFT JOIN (SELECT a.u, a.v FROM re a JOIN re b ON a.u = b.v AND a.v = b.u) m ON m.u = id GROUP BY id),
hd AS (SELECT DISTINCT part FROM pa WHERE part NOT IN (SELECT y.part FROM ho JOIN pa x ON x.id = u JOIN pa y ON y.id = v WHERE x.part <> y.part)),
un AS (SELECT DISTINCT id, h FROM (SELECT id, part AS h FROM pa WHERE part IN (SELECT part FROM hd) UNION ALL SELECT v, part FROM re JOIN pa ON pa.id = u WHERE part IN (SELECT part FROM hd))),
si AS (SELECT id, min(h) AS h FROM un GROUP BY id HAVING count(*) = 1),
tp AS (SELECT part AS h, mem AS top FROM pa JOIN st USING (id) QUALIFY row_number() OVER (PARTITION BY part ORDER BY len(mem) DESC, mem) = 1),
jn AS (SELECT sn.*, h, count(*) OVER (PARTITION BY h) AS n FROM sn JOIN st ON sn.g = st.g AND sn.mem = st.mem JOIN si USING (id)),
ex AS (SELECT g, h, unnest(segs) AS segment FROM jn WHERE n >= 6)
SELECT g AS subgraph, array_to_string(top, ',') AS top, segment, count(*) AS coverage FROM ex JOIN tp USING (h) GROUP BY 1, 2, 3 HAVING count(*) >= 6""",
}
