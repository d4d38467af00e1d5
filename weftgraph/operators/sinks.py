"""Text outputs: FASTA, GFA, CIGAR strings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_lines(segments: DataFrame, key: str = "id", sequence: str = "sequence") -> DataFrame:
    """(value): '>id length n' and the sequence, one row a record."""
    return segments.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit(" length "), F.length(sequence).cast("string"), F.lit("\n"), F.col(sequence)).alias("value"))


def gfa_lines(segments: DataFrame, links: DataFrame, *, with_sequence: bool = True) -> DataFrame:
    """(value) of a GFA 1.0 file: segments (id, sequence, reads) and links (from_id, from_strand, to_id, to_strand, cigar).

    The header is a row among the others; writers that need it first sort by `value` within one file.
    """
    spark = segments.sparkSession
    body = F.col("sequence") if with_sequence else F.lit("*")
    s = segments.select(F.concat_ws("\t", F.lit("S"), F.col("id").cast("string"), body, F.concat(F.lit("LN:i:"), F.length("sequence").cast("string")), F.concat(F.lit("RC:i:"), F.col("reads").cast("string"))).alias("value"))
    l_ = links.select(F.concat_ws("\t", F.lit("L"), F.col("from_id").cast("string"), "from_strand", F.col("to_id").cast("string"), "to_strand", "cigar").alias("value"))
    header = spark.createDataFrame([("H\tVN:Z:1.0",)], "value string")
    return header.unionByName(s).unionByName(l_)


def run_length_cigar(left: Column, right: Column) -> Column:
    """The CIGAR that aligns two raw stretches with equal run-length bases, from their repeat counts.

    Each run matches over the lesser count; what the left has more is a deletion, the right an insertion; equal operations in a row join.
    """
    ops = F.flatten(F.zip_with(left, right, lambda a, b: F.filter(
        F.array(F.struct(F.least(a, b).cast("int").alias("n"), F.lit("M").alias("op")), F.struct(F.abs(a - b).cast("int").alias("n"), F.when(a > b, "D").otherwise("I").alias("op"))), lambda x: x["n"] > 0,
    )))
    empty = F.array().cast("array<struct<n:int,op:string>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).getField("op") == x["op"])
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["n"] + x["n"]).alias("n"), x["op"].alias("op"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(ops, empty, join)
    return F.array_join(F.transform(merged, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def summary_json(**tables: DataFrame) -> DataFrame:
    """One row (json) with the columns of one-row tables, by table name."""
    out: DataFrame | None = None
    for name, df in tables.items():
        one = df.select(F.struct("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct("*")).alias("json"))


def read_summary(reads: DataFrame, **counts: DataFrame) -> DataFrame:
    """A row a read with a count from each table (read_id), 0 where it has none."""
    out = reads
    for name, df in counts.items():
        n = df.groupBy("read_id").agg(F.count("*").alias(name))
        out = out.join(n, "read_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (value) rows as text files."""
    lines.select("value").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header, one file a partition."""
    rows.write.option("header", True).csv(path)
