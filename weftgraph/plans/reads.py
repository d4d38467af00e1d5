"""Queries on reads and k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import kmers as K
from weftgraph.operators import sequences as S
from weftgraph.plans.common import BOTH, DNA, RUNS, sql_hash, table
from weftgraph.sources.sequences import read_fasta, read_fastq
from weftgraph.storage import new_path

KMER, RANDOM, ENRICHMENT, READ_ENRICHMENT, DENSITY, DISTANCE, SAMPLE = 8, 0.1, 3.0, 50.0, 0.1, 20, 0.3
COVERAGE, DELTA = 1_000_000, 60


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dna_view(table(spark, sf_dir, "documents"))


def _encoded(spark, sf_dir) -> DataFrame:
    return S.run_length_encode(_dna(spark, sf_dir).where("bases != ''"))


def rle_encode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("read_id", "rle", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"), S.raw_length(F.col("counts")).alias("raw_length"))


def rle_round_trip(spark, sf_dir):
    return _encoded(spark, sf_dir).select("read_id", F.md5(S.run_length_decode(F.col("rle"), F.col("counts"))).alias("digest"))


def raw_positions(spark, sf_dir):
    found = S.raw_positions(_encoded(spark, sf_dir))
    return found.groupBy("read_id").agg(F.count("*").alias("positions"), F.sum("raw_position").cast("long").alias("total"), F.max("raw_position").alias("last"))


def reverse_complement(spark, sf_dir):
    return _dna(spark, sf_dir).select("read_id", S.reverse_complement("bases").alias("bases"))


def metadata_lookup(spark, sf_dir):
    meta = F.replace(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", S.metadata_value(meta, "page").alias("page"), S.metadata_value(meta, "ref").alias("ref"))


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("n_chars").alias("length"))


def length_histogram(spark, sf_dir):
    return S.length_histogram(_lengths(spark, sf_dir), 1000)


def cumulative_lengths(spark, sf_dir):
    return S.cumulative_lengths(_lengths(spark, sf_dir)).withColumn("fraction", F.round("fraction", 9))


def length_n50(spark, sf_dir):
    return S.read_n50(_lengths(spark, sf_dir))


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("length"))


def assembly_statistics(spark, sf_dir):
    return S.assembly_statistics(_segments(spark, sf_dir), "o_orderkey", "length").drop("total")


def assembly_n50(spark, sf_dir):
    return S.assembly_n50(_segments(spark, sf_dir), "o_orderkey", "length")


def coverage_cutoff(spark, sf_dir):
    lengths = _lengths(spark, sf_dir)
    cutoff = S.coverage_cutoff(lengths, COVERAGE)
    counted = lengths.crossJoin(F.broadcast(cutoff))  # one row
    return counted.groupBy("cutoff").agg(
        F.count_if(F.col("length") >= F.col("cutoff")).alias("kept"), F.coalesce(F.sum(F.when(F.col("length") >= F.col("cutoff"), F.col("length"))), F.lit(0)).alias("kept_bases"),
        F.count_if(F.col("length") < F.col("cutoff")).alias("dropped"),
    )


def same_channel_pairs(spark, sf_dir):
    return S.same_channel_pairs(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", DELTA, "event_id")


def suppress_candidates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a, b = events.select(F.col("event_id").alias("id0"), "user_id", "props"), events.select(F.col("event_id").alias("id1"), "user_id", "props")
    candidates = a.join(b, ["user_id", "props"]).where("id0 < id1").select("id0", "id1")
    return S.suppress_candidates(candidates, same_channel_pairs(spark, sf_dir))


def fasta_round_trip(spark, sf_dir):
    path = new_path(spark, "reads") + ".fasta"
    reads = _dna(spark, sf_dir).where("bases != ''")
    reads.select(F.concat(F.lit(">r"), F.col("read_id").cast("string"), F.lit(" len="), F.length("bases").cast("string"), F.lit("\n"), F.col("bases")).alias("value")).write.text(path)
    return read_fasta(spark, path, 100).select("name", "meta", "length", F.md5("bases").alias("digest"))


def fastq_round_trip(spark, sf_dir):
    path = new_path(spark, "reads") + ".fastq"
    reads = _dna(spark, sf_dir).where("bases != ''")
    reads.select(F.concat_ws("\n", F.concat(F.lit("@r"), F.col("read_id").cast("string")), F.col("bases"), F.lit("+"), F.repeat(F.lit("I"), F.length("bases"))).alias("value")).write.text(path)
    return read_fastq(spark, path, 100).select("name", "length", F.md5("bases").alias("digest"))


def _frequency(spark, sf_dir):
    return K.kmer_frequency(_dna(spark, sf_dir), KMER)


def _random(spark, sf_dir):
    return K.select_random(_frequency(spark, sf_dir), RANDOM)


def _markers(spark, sf_dir, **named):
    return K.find_markers(_dna(spark, sf_dir), _random(spark, sf_dir), KMER, **named)


def markers_by_kmer(spark, sf_dir):
    found = K.markers_by_kmer(K.marker_arrays(_dna(spark, sf_dir), _random(spark, sf_dir), KMER))
    return found.select("oriented_id", F.md5(F.array_join(F.transform("sorted_markers", lambda x: F.concat_ws(":", x["kmer"], x["ordinal"].cast("string"))), ",")).alias("digest"))


def marker_partners(spark, sf_dir):
    found = K.reverse_complement_markers(_markers(spark, sf_dir, counted=True), None, KMER)
    return found.groupBy("oriented_id").agg(F.count("*").alias("n"), F.sum(F.col("ordinal") * F.col("position")).cast("long").alias("checksum"))


QUERIES = {
    "rle_encode": rle_encode, "rle_round_trip": rle_round_trip, "raw_positions": raw_positions, "reverse_complement": reverse_complement,
    "metadata_lookup": metadata_lookup, "length_histogram": length_histogram, "cumulative_lengths": cumulative_lengths, "length_n50": length_n50,
    "assembly_statistics": assembly_statistics, "assembly_n50": assembly_n50, "coverage_cutoff": coverage_cutoff, "same_channel_pairs": same_channel_pairs,
    "suppress_candidates": suppress_candidates, "fasta_round_trip": fasta_round_trip, "fastq_round_trip": fastq_round_trip,
    "kmer_frequency": _frequency,
    "kmers_run_length": lambda s, d: _frequency(s, d).where(K.is_run_length_kmer(F.col("kmer"))),
    "markers_random": _random,
    "markers_global_enrichment": lambda s, d: K.select_not_enriched(_frequency(s, d), KMER, ENRICHMENT, DENSITY),
    "markers_read_enrichment": lambda s, d: K.select_not_enriched_in_reads(_dna(s, d), KMER, READ_ENRICHMENT, DENSITY),
    "markers_distance": lambda s, d: K.select_distant(_dna(s, d), KMER, DISTANCE, DENSITY),
    "find_markers": _markers,
    "marker_frequency": lambda s, d: K.marker_frequency(_markers(s, d)),
    "markers_by_kmer": markers_by_kmer,
    "marker_partners": marker_partners,
    "downsample_markers": lambda s, d: _markers(s, d, sample=SAMPLE).where("sampled_ordinal is not null"),
}

_RC = "translate(reverse({0}), 'ACGT', 'TGCA')"
_FREQ = BOTH + f""", places AS (SELECT oriented_id, bases, unnest(range(0, length(bases) - {KMER - 1})) AS position FROM strands WHERE length(bases) >= {KMER}),
occ AS (SELECT oriented_id, position, substr(bases, position + 1, {KMER}) AS kmer, length(bases) AS length FROM places),
freq AS (SELECT kmer, count(*) AS frequency FROM occ GROUP BY kmer)"""
_P = 1 - (1 - RANDOM) ** 0.5
_SEL = _FREQ + f""", picked AS (
  SELECT kmer, frequency FROM freq WHERE {sql_hash('kmer')} < {int(_P * 16**15)} OR {sql_hash(_RC.format('kmer'))} < {int(_P * 16**15)}
)"""
_MARK = _SEL + ", marks AS (SELECT oriented_id, CAST(row_number() OVER (PARTITION BY oriented_id ORDER BY position) - 1 AS INTEGER) AS ordinal, kmer, CAST(position AS INTEGER) AS position FROM occ WHERE kmer IN (SELECT kmer FROM picked))"


def _density(source: str) -> str:
    return f""", cand AS ({source}),
pairs AS (SELECT least(kmer, {_RC.format('kmer')}) AS pair, sum(frequency) AS f FROM cand GROUP BY 1),
ranked AS (SELECT pair, coalesce(sum(f) OVER (ORDER BY {sql_hash('pair')}, pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pairs)
SELECT kmer, CAST(frequency AS BIGINT) AS frequency FROM cand
WHERE least(kmer, {_RC.format('kmer')}) IN (SELECT pair FROM ranked WHERE before < {DENSITY} * (SELECT sum(frequency) FROM cand))"""


ORACLES = {
    "rle_encode": f"WITH {RUNS} SELECT read_id, string_agg(ch, '' ORDER BY r) AS rle, string_agg(CAST(n AS VARCHAR), ',' ORDER BY r) AS counts, CAST(sum(n) AS BIGINT) AS raw_length FROM runs WHERE read_id IN (SELECT read_id FROM kept) GROUP BY read_id",
    "rle_round_trip": f"WITH {RUNS} SELECT read_id, md5(bases) AS digest FROM dna WHERE read_id IN (SELECT read_id FROM kept)",
    "raw_positions": f"""WITH {RUNS}, p AS (SELECT read_id, coalesce(sum(n) OVER (PARTITION BY read_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM runs WHERE read_id IN (SELECT read_id FROM kept))
SELECT read_id, count(*) AS positions, CAST(sum(q) AS BIGINT) AS total, CAST(max(q) AS BIGINT) AS last FROM p GROUP BY read_id""",
    "reverse_complement": f"WITH {DNA} SELECT read_id, translate(reverse(bases), 'ACGT', 'TGCA') AS bases FROM dna",
    "metadata_lookup": r"""WITH m AS (SELECT page_id, replace(regexp_extract(url, '\?([^#]*)', 1), '&', ' ') AS meta FROM pages)
SELECT page_id, nullif(regexp_extract(meta, '(?:^|\s)page=(\S+)', 1), '') AS page, nullif(regexp_extract(meta, '(?:^|\s)ref=(\S+)', 1), '') AS ref FROM m""",
    "length_histogram": "SELECT CAST(n_chars // 1000 * 1000 AS BIGINT) AS bin, count(*) AS reads, CAST(sum(n_chars) AS BIGINT) AS bases FROM documents GROUP BY 1",
    "cumulative_lengths": """WITH h AS (SELECT n_chars AS length, count(*) AS reads, CAST(sum(n_chars) AS BIGINT) AS bases FROM documents GROUP BY 1)
SELECT length, reads, bases, CAST(sum(reads) OVER w AS BIGINT) AS cumulative_reads, CAST(sum(bases) OVER w AS BIGINT) AS cumulative_bases,
  round(CAST(sum(bases) OVER w AS DOUBLE) / sum(bases) OVER (), 9) AS fraction FROM h WINDOW w AS (ORDER BY length DESC)""",
    "length_n50": """WITH h AS (SELECT n_chars AS length, sum(n_chars) AS bases FROM documents GROUP BY 1), c AS (SELECT length, sum(bases) OVER (ORDER BY length DESC) AS c, sum(bases) OVER () AS t FROM h)
SELECT max(length) AS n50 FROM c WHERE 2 * c > t""",
    "assembly_statistics": """SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS length, row_number() OVER w AS rank, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER w AS BIGINT) AS cumulative
FROM orders WINDOW w AS (ORDER BY CAST(floor(o_totalprice) AS BIGINT) DESC, o_orderkey)""",
    "assembly_n50": """WITH s AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS length, row_number() OVER w AS r, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER w AS c FROM orders WINDOW w AS (ORDER BY CAST(floor(o_totalprice) AS BIGINT) DESC, o_orderkey)),
t AS (SELECT count(*) AS segments, CAST(sum(length) AS BIGINT) AS total FROM s)
SELECT segments, total, (SELECT length FROM s WHERE c >= total // 2 ORDER BY r LIMIT 1) AS n50 FROM t""",
    "coverage_cutoff": f"""WITH h AS (SELECT n_chars AS length, sum(n_chars) AS b FROM documents GROUP BY 1), c AS (SELECT length, sum(b) OVER (ORDER BY length ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM h),
k AS (SELECT coalesce(max(length), 0) AS cutoff FROM c WHERE left_ > {COVERAGE})
SELECT cutoff, count(*) FILTER (n_chars >= cutoff) AS kept, CAST(coalesce(sum(n_chars) FILTER (n_chars >= cutoff), 0) AS BIGINT) AS kept_bases, count(*) FILTER (n_chars < cutoff) AS dropped FROM documents, k GROUP BY cutoff""",
    "same_channel_pairs": f"SELECT a.event_id AS id0, b.event_id AS id1 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND b.event_id - a.event_id < {DELTA}",
    "suppress_candidates": f"""SELECT a.event_id AS id0, b.event_id AS id1 FROM events a JOIN events b ON a.user_id = b.user_id AND a.props = b.props AND a.event_id < b.event_id
WHERE NOT (a.event_type = b.event_type AND b.event_id - a.event_id < {DELTA})""",
    "fasta_round_trip": f"WITH {DNA} SELECT 'r' || read_id AS name, 'len=' || length(bases) AS meta, CAST(length(bases) AS BIGINT) AS length, md5(bases) AS digest FROM dna WHERE length(bases) >= 100",
    "fastq_round_trip": f"WITH {DNA} SELECT 'r' || read_id AS name, CAST(length(bases) AS BIGINT) AS length, md5(bases) AS digest FROM dna WHERE length(bases) >= 100",
    "kmer_frequency": f"WITH {_FREQ} SELECT kmer, frequency FROM freq",
    "kmers_run_length": f"WITH {_FREQ} SELECT kmer, frequency FROM freq WHERE NOT regexp_matches(kmer, 'AA|CC|GG|TT')",
    "markers_random": f"WITH {_SEL} SELECT kmer, frequency FROM picked",
    "markers_global_enrichment": f"WITH {_FREQ}" + _density(f"SELECT kmer, frequency FROM freq WHERE frequency <= floor({ENRICHMENT} * (SELECT sum(frequency) FROM freq) / {4**KMER})"),
    "markers_read_enrichment": f"WITH {_FREQ}, per AS (SELECT oriented_id, kmer, count(*) AS n, min(length) AS length FROM occ GROUP BY 1, 2)"
    + _density(f"SELECT kmer, sum(n) AS frequency FROM per GROUP BY kmer HAVING NOT bool_or(n > greatest(floor({READ_ENRICHMENT} * (length - {KMER - 1}) / {4**KMER}), 1))"),
    "markers_distance": f"WITH {_FREQ}, gaps AS (SELECT kmer, position - lag(position) OVER (PARTITION BY oriented_id, kmer ORDER BY position) AS gap FROM occ)"
    + _density(f"SELECT kmer, count(*) AS frequency FROM gaps GROUP BY kmer HAVING coalesce(min(gap), {DISTANCE}) >= {DISTANCE}"),
    "find_markers": f"WITH {_MARK} SELECT * FROM marks",
    "marker_frequency": f"WITH {_MARK} SELECT kmer, count(*) AS frequency FROM marks GROUP BY kmer",
    "markers_by_kmer": f"WITH {_MARK} SELECT oriented_id, md5(string_agg(kmer || ':' || ordinal, ',' ORDER BY kmer, ordinal)) AS digest FROM marks GROUP BY 1",
    "marker_partners": f"WITH {_MARK} SELECT oriented_id, count(*) AS n, CAST(sum(CAST(ordinal AS BIGINT) * position) AS BIGINT) AS checksum FROM marks GROUP BY 1",
    "downsample_markers": f"""WITH {_MARK} SELECT oriented_id, ordinal, kmer, position, CAST(row_number() OVER (PARTITION BY oriented_id ORDER BY ordinal) - 1 AS INTEGER) AS sampled_ordinal
FROM marks WHERE {sql_hash('least(kmer, ' + _RC.format('kmer') + ')')} < {int(SAMPLE * 16**15)}""",
}
