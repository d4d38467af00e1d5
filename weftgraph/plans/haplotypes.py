"""Queries of bubble chains: a brand is a chain, its parts in order are the edges, every other one a bubble of two branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import haplotypes as H
from weftgraph.operators import sinks
from weftgraph.plans.common import table
from weftgraph.storage import materialize


def _branches(spark, sf_dir) -> DataFrame:
    letters = lambda x: F.upper(F.regexp_replace(x, "[^a-zA-Z]", ""))
    place = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long")
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chain"), place.alias("position"), letters("p_name").alias("n"), letters("p_type").alias("t"), "p_size")
    bubble = (F.col("position") % 2 == 1) & (F.col("p_size") % 5 != 0) | (F.col("p_size") % 7 == 0)
    second = F.concat(F.substring("n", 1, 4), "t", F.expr("right(n, 3)"))
    sides = F.when(bubble, F.array(F.col("n"), second)).otherwise(F.array("n"))
    rows = parts.withColumns({"bubble": bubble}).select("chain", "position", "p_size", "bubble", F.posexplode(sides).alias("branch", "sequence"))
    phased = F.col("bubble") & (F.col("p_size") % 4 != 0)
    return rows.select(
        "chain", "position", "branch", "sequence", F.when(F.col("branch") == 0, F.col("p_size")).otherwise(25).cast("long").alias("coverage"),
        F.when(phased, F.floor(F.col("position") / 9)).cast("long").alias("component"), F.when(phased, F.col("p_size") % 2).cast("int").alias("phase"),
    )


def transfer(spark, sf_dir):
    return H.transfer(_branches(spark, sf_dir)).select("chain", "position", "branch", "sequence")


def phased_sequences(spark, sf_dir):
    return H.phased(_branches(spark, sf_dir))


def phased_gfa(spark, sf_dir):
    pieces = materialize(H.phased(_branches(spark, sf_dir)), "phased")
    return sinks.gfa_lines(pieces.select(F.col("name").alias("id"), "sequence", F.lit(1).alias("reads")), H.joined(pieces))


QUERIES = {
    "transfer": transfer, "transfer_counts": lambda s, d: H.transfer_counts(_branches(s, d)), "phasing_spans": lambda s, d: H.phasing_spans(_branches(s, d)),
    "phased_sequences": phased_sequences, "haploid_sequences": lambda s, d: H.haploid(_branches(s, d)), "detailed_sequences": lambda s, d: H.detailed(_branches(s, d)), "phased_gfa": phased_gfa,
}

_BR = """pt AS (SELECT p_brand AS chain, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position, upper(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS n, upper(regexp_replace(p_type, '[^a-zA-Z]', '', 'g')) AS t, p_size FROM part),
bu AS (SELECT *, position % 2 = 1 AND p_size % 5 <> 0 OR p_size % 7 = 0 AS bubble FROM pt),
si AS (SELECT *, 0 AS branch, n AS sequence FROM bu UNION ALL SELECT *, 1, left(n, 4) || t || right(n, 3) FROM bu WHERE bubble),
br AS (SELECT chain, position, branch, sequence, CASE branch WHEN 0 THEN p_size ELSE 25 END AS coverage, CASE WHEN bubble AND p_size % 4 <> 0 THEN position // 9 END AS component, CASE WHEN bubble AND p_size % 4 <> 0 THEN p_size % 2 END AS phase FROM si),
ed AS (SELECT chain, position, count(*) AS ploidy, min(sequence) AS lo, max(sequence) AS hi, min(reverse(sequence)) AS tl, max(reverse(sequence)) AS th, min(length(sequence)) AS sh, max(component) AS component FROM br GROUP BY 1, 2),
nb AS (SELECT *, lag(ploidy) OVER w AS pb, lead(ploidy) OVER w AS pn FROM ed WINDOW w AS (PARTITION BY chain ORDER BY position)),
ct AS (SELECT chain, position, lo, sh, list_max(list_filter(range(0, length(lo) + 1), lambda i: left(lo, i) = left(hi, i))) AS b, list_max(list_filter(range(0, length(tl) + 1), lambda i: left(tl, i) = left(th, i))) AS f
  FROM nb WHERE ploidy > 1 AND pb = 1 AND pn = 1),
tc AS (SELECT chain, position, lo, CAST(b - ceil(greatest(b + f - sh, 0) / 2.0) AS INTEGER) AS backward, CAST(f - floor(greatest(b + f - sh, 0) / 2.0) AS INTEGER) AS forward FROM ct)"""
_SPANS = """sb AS (SELECT chain, position, last_value(component IGNORE NULLS) OVER (PARTITION BY chain ORDER BY position ROWS UNBOUNDED PRECEDING) AS x,
  first_value(component IGNORE NULLS) OVER (PARTITION BY chain ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM ed),
sc AS (SELECT chain, position, CASE WHEN x = y THEN x END AS component FROM sb),
sd AS (SELECT *, CASE WHEN lag(position) OVER w IS NULL OR component IS DISTINCT FROM lag(component) OVER w THEN 1 ELSE 0 END AS o FROM sc WINDOW w AS (PARTITION BY chain ORDER BY position)),
ps AS (SELECT chain, position, CAST(sum(o) OVER (PARTITION BY chain ORDER BY position) - 1 AS BIGINT) AS region, component FROM sd)"""
_TOLD = """st AS (SELECT * FROM br QUALIFY row_number() OVER (PARTITION BY chain, position ORDER BY coverage DESC, branch) = 1),
pc AS (SELECT chain, position, sequence, h AS haplotype FROM st, range(2) t(h) WHERE component IS NULL UNION ALL SELECT chain, position, sequence, xor(branch, phase) FROM br WHERE component IS NOT NULL),
pz AS (SELECT CASE WHEN ps.component IS NULL THEN 'UR.' || chain || '.' || region ELSE 'PR.' || chain || '.' || region || '.' || ps.component || '.' || haplotype END AS name, chain, region AS place, string_agg(sequence, '' ORDER BY position) AS sequence
  FROM pc JOIN ps USING (chain, position) WHERE ps.component IS NOT NULL OR haplotype = 0 GROUP BY chain, region, ps.component, haplotype)"""

ORACLES = {
    "transfer_counts": f"WITH {_BR} SELECT chain, position, backward, forward FROM tc",
    "transfer": f"""WITH {_BR}, gv AS (SELECT ed.chain, ed.position, coalesce(backward, 0) AS b, coalesce(forward, 0) AS f, left(tc.lo, backward) AS pre, right(tc.lo, forward) AS suf FROM ed LEFT JOIN tc USING (chain, position)),
en AS (SELECT chain, position, b, f, coalesce(lag(suf) OVER w, '') AS head, coalesce(lead(pre) OVER w, '') AS tail FROM gv WINDOW w AS (PARTITION BY chain ORDER BY position))
SELECT chain, position, branch, head || substr(sequence, b + 1, length(sequence) - b - f) || tail AS sequence FROM br JOIN en USING (chain, position)""",
    "phasing_spans": f"WITH {_BR}, {_SPANS} SELECT * FROM ps",
    "phased_sequences": f"WITH {_BR}, {_SPANS}, {_TOLD} SELECT * FROM pz",
    "haploid_sequences": f"WITH {_BR}, {_TOLD.split('pc AS')[0].rstrip().rstrip(',')} SELECT 'H.' || chain AS name, chain, CAST(0 AS BIGINT) AS place, string_agg(sequence, '' ORDER BY position) AS sequence FROM st GROUP BY chain",
    "detailed_sequences": f"WITH {_BR} SELECT chain || '.' || position || '.' || branch AS name, chain, position AS place, sequence FROM br",
    "phased_gfa": f"""WITH {_BR}, {_SPANS}, {_TOLD}, ld AS (SELECT chain, place, lead(place) OVER (PARTITION BY chain ORDER BY place) AS nx FROM (SELECT DISTINCT chain, place FROM pz))
SELECT 'H' || chr(9) || 'VN:Z:1.0' AS value UNION ALL SELECT concat_ws(chr(9), 'S', name, sequence, 'LN:i:' || length(sequence), 'RC:i:1') FROM pz
UNION ALL SELECT concat_ws(chr(9), 'L', a.name, '+', b.name, '+', '0M') FROM ld JOIN pz a ON a.chain = ld.chain AND a.place = ld.place JOIN pz b ON b.chain = ld.chain AND b.place = ld.nx""",
}
