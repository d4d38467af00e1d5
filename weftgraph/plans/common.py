"""Table access and SQL pieces that several query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; documents in so few row groups that cores would stand idle are dealt out first."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name == "documents" and found.rdd.getNumPartitions() < cores else found


#: Reads made of documents, as operators.sequences.dna_view() makes them.
DNA = """dna AS (
  SELECT doc_id AS read_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS bases
  FROM documents
)"""
BOTH = DNA + """, strands AS (
  SELECT read_id * 2 AS oriented_id, bases FROM dna UNION ALL SELECT read_id * 2 + 1, translate(reverse(bases), 'ACGT', 'TGCA') FROM dna
)"""
#: One row a run of equal bases: (read_id, r, ch, n).
RUNS = DNA + """, letters AS (SELECT read_id, unnest(range(1, length(bases) + 1)) AS i, bases FROM dna WHERE length(bases) > 0),
opened AS (
  SELECT read_id, i, substr(bases, i, 1) AS ch, CASE WHEN i > 1 AND substr(bases, i - 1, 1) = substr(bases, i, 1) THEN 0 ELSE 1 END AS o FROM letters
),
numbered AS (SELECT read_id, ch, sum(o) OVER (PARTITION BY read_id ORDER BY i) AS r FROM opened),
runs AS (SELECT read_id, r, min(ch) AS ch, count(*) AS n FROM numbered GROUP BY read_id, r),
kept AS (SELECT read_id FROM runs GROUP BY read_id HAVING max(n) < 256)"""


def sql_hash(text: str) -> str:
    """operators.kmers.stable_hash() in SQL."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


#: Documents as words: (oriented_id, ordinal, kmer).
WORDS = r"""words AS (
  SELECT oriented_id, unnest(w) AS kmer, unnest(range(len(w))) AS ordinal
  FROM (SELECT doc_id AS oriented_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents)
)"""
