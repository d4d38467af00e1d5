"""Queries of walks over segments: users are reads, an event type on a day is a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import journeys as J
from weftgraph.operators import path_assembly as P
from weftgraph.operators import walks as W
from weftgraph.plans.common import table
from weftgraph.storage import materialize

#: A day has few owners in common with another, so less similarity is asked than by default; some links are too far back.
_OPTIONS = W.WalkOptions(least_jaccard=0.26)


def _events(spark, sf_dir) -> DataFrame:
    segment = (F.dayofyear("ts") * 100 + F.ascii("event_type") % 100).cast("long")
    minute = F.expr("cast(floor(unix_micros(cast(ts as timestamp)) / 60000000) as bigint)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), segment.alias("segment"), minute.alias("minute"), "event_id")


def _visits(spark, sf_dir) -> DataFrame:
    return materialize(J.segment_journeys(_events(spark, sf_dir), "owner", ["minute", "event_id"], "segment"), "journeys")


def _ground(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    events = _events(spark, sf_dir)
    visits = _visits(spark, sf_dir)
    steps = materialize(J.transitions(visits, "owner", "segment"), "transitions")
    found = materialize(J.links(steps.withColumn("gap", F.col("first1") - F.col("last0") - 200), 3, "gap"), "links")
    members = materialize(J.segment_members(events.withColumnRenamed("event_id", "at"), "owner", "segment", "at"), "members")
    spans = events.groupBy("owner").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    lengths = events.select("segment").distinct().withColumn("length", F.lit(100).cast("long"))
    return visits, steps, found, materialize(J.segment_pairs(members, spans, lengths), "pairs")


def _listed(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


def jaccard_graph(spark, sf_dir):
    return W.jaccard_graph(*_ground(spark, sf_dir), options=_OPTIONS).select("s0", "s1", "forward", "backward", _listed("segments"))


def follow(spark, sf_dir):
    """Paths from every segment of the first three days."""
    ground = _ground(spark, sf_dir)
    starts = ground[0].where("segment < 400").select("segment").distinct()
    return W.assembly_paths(starts, *ground, options=_OPTIONS)


def path_assembly(spark, sf_dir):
    """The letters along the paths of follow(): an event type is a marker of two letters, an owner's bases across a link those of its two events."""
    ground = _ground(spark, sf_dir)
    paths = W.assembly_paths(ground[0].where("segment < 400").select("segment").distinct(), *ground, options=_OPTIONS)
    letter = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    word = lambda c: F.concat(letter(F.col(c)), letter(F.floor(F.col(c) / 4)))
    segments = ground[0].select("segment").distinct().select("segment", word("segment").alias("sequence"), F.array(F.lit(0)).alias("offsets"))
    crossings = ground[1].select("owner", "s0", "s1", F.lit(0).alias("p0"), F.lit(0).alias("p1"), F.concat(word("s0"), word("s1")).alias("sequence"))
    return P.assemble_paths(paths, segments, crossings, ground[0], 2)


QUERIES = {"jaccard_graph": jaccard_graph, "follow": follow, "path_assembly": path_assembly}

_GROUND = """ev AS (SELECT user_id AS owner, event_id, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS minute, CAST(dayofyear(ts) * 100 + ascii(event_type) % 100 AS BIGINT) AS segment FROM events),
op AS (SELECT *, CASE WHEN lag(segment) OVER w = segment THEN 0 ELSE 1 END AS o FROM ev WINDOW w AS (PARTITION BY owner ORDER BY minute, event_id)),
ru AS (SELECT *, sum(o) OVER (PARTITION BY owner ORDER BY minute, event_id) AS idx FROM op),
jo AS (SELECT owner, idx, min(segment) AS segment, min(minute) AS first, max(minute) AS last FROM ru GROUP BY 1, 2),
tr AS (SELECT owner, segment AS s0, lead(segment) OVER w AS s1, last AS last0, lead(first) OVER w AS first1 FROM jo WINDOW w AS (PARTITION BY owner ORDER BY idx)),
li AS (SELECT s0, s1 FROM tr WHERE s1 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND round(avg(first1 - last0 - 200)) >= -20),
me AS (SELECT segment, owner, CAST(round(avg(event_id)) AS BIGINT) AS off FROM ev GROUP BY 1, 2),
sp AS (SELECT owner, min(event_id) AS f, max(event_id) AS l FROM ev GROUP BY 1),
po AS (SELECT a.segment AS a, b.segment AS b, count(*) AS common, CAST(round(avg(b.off - a.off)) AS BIGINT) AS off FROM me a JOIN me b ON a.owner = b.owner AND a.segment < b.segment GROUP BY 1, 2),
na AS (SELECT segment AS s, count(*) AS n FROM me GROUP BY 1),
pj AS (SELECT a, b FROM po JOIN na x ON x.s = a JOIN na y ON y.s = b WHERE common >= 3 AND round(CAST(common AS DOUBLE) / (x.n + y.n - common), 6) >= 0.26),
al AS (SELECT a AS ref, b AS nx FROM pj UNION ALL SELECT b, a FROM pj UNION ALL SELECT s, s FROM na WHERE n >= 3),
so AS (SELECT segment AS ref, owner FROM jo GROUP BY 1, 2 HAVING count(*) = 1),
lo AS (SELECT s0, s1, owner FROM tr SEMI JOIN li USING (s0, s1) GROUP BY 1, 2, 3 HAVING count(*) = 1),
cn AS (SELECT ref, s0, s1, count(*) AS n FROM so JOIN lo USING (owner) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
bf AS (SELECT ref, s0 AS cur, s1 AS nx FROM cn QUALIFY row_number() OVER (PARTITION BY ref, s0 ORDER BY n DESC, s1) = 1),
bb AS (SELECT ref, s1 AS cur, s0 AS nx FROM cn QUALIFY row_number() OVER (PARTITION BY ref, s1 ORDER BY n DESC, s0) = 1)"""


def _walks(name: str, best: str) -> str:
    return f"""{name}(start, cur, path, done) AS (
  SELECT ref, nx, []::BIGINT[], EXISTS (SELECT 1 FROM al WHERE al.ref = {best}.ref AND al.nx = {best}.nx) FROM {best} WHERE ref = cur
  UNION ALL SELECT w.start, b.nx, list_append(w.path, w.cur), al.ref IS NOT NULL FROM {name} w JOIN {best} b ON b.ref = w.start AND b.cur = w.cur
    LEFT JOIN al ON al.ref = w.start AND al.nx = b.nx WHERE NOT w.done AND NOT list_contains(list_append(w.path, w.cur), b.nx)
)"""


ORACLES = {
    "jaccard_graph": f"""WITH RECURSIVE {_GROUND}, {_walks("wf", "bf")}, {_walks("wb", "bb")},
f AS (SELECT start AS s0, cur AS s1, path FROM wf WHERE done), b AS (SELECT cur AS s0, start AS s1, list_reverse(path) AS path FROM wb WHERE done)
SELECT coalesce(f.s0, b.s0) AS s0, coalesce(f.s1, b.s1) AS s1, f.s0 IS NOT NULL AS forward, b.s0 IS NOT NULL AS backward, array_to_string(coalesce(f.path, b.path), ',') AS segments
FROM f FULL JOIN b ON f.s0 = b.s0 AND f.s1 = b.s1""",
    "follow": f"""WITH RECURSIVE {_GROUND},
p(start, ref, cur, seen, waiting, n, old, hit) AS (
  SELECT DISTINCT segment, segment, segment, []::VARCHAR[], []::BIGINT[], CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM jo WHERE segment < 400
  UNION ALL
  SELECT p.start, CASE WHEN al.ref IS NOT NULL THEN bf.nx ELSE p.ref END, bf.nx, list_append(p.seen, p.ref || ' ' || bf.nx),
    CASE WHEN p.hit THEN [bf.nx] ELSE list_append(p.waiting, bf.nx) END, p.n + CASE WHEN p.hit THEN len(p.waiting) ELSE 0 END, p.ref, al.ref IS NOT NULL
  FROM p JOIN bf ON bf.ref = p.ref AND bf.cur = p.cur LEFT JOIN al ON al.ref = p.ref AND al.nx = bf.nx WHERE NOT list_contains(p.seen, p.ref || ' ' || bf.nx)
),
r AS (SELECT start, n, old, cur, unnest(range(1, len(waiting) + 1)) AS i, waiting FROM p WHERE hit)
SELECT DISTINCT segment AS start, CAST(0 AS BIGINT) AS idx, segment, true AS is_primary, CAST(NULL AS BIGINT) AS previous, CAST(NULL AS BIGINT) AS next FROM jo WHERE segment < 400
UNION ALL SELECT start, n + i, waiting[i], waiting[i] = cur, CASE WHEN waiting[i] <> cur THEN old END, CASE WHEN waiting[i] <> cur THEN cur END FROM r""",
}
ORACLES["path_assembly"] = f"""SELECT start, string_agg(substr('ACGT', segment % 4 + 1, 1) || substr('ACGT', (segment // 4) % 4 + 1, 1), '' ORDER BY idx) AS sequence FROM ({ORACLES["follow"]}) p GROUP BY start"""
