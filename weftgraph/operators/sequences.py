"""Operators on reads: run lengths, strands, metadata, lengths and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A run of so many equal bases can't be stored, and its read is discarded.
LONGEST_RUN = 256


def reverse_complement(bases: Column | str) -> Column:
    """the other strand, read backwards."""
    return F.translate(F.reverse(bases), "ACGT", "TGCA")


def oriented(bases: Column, strand: Column) -> Column:
    """A read's bases on strand 0 or 1."""
    return F.when(strand == 0, bases).otherwise(reverse_complement(bases))


def with_both_strands(reads: DataFrame, key: str, bases: str) -> DataFrame:
    """Both orientations of every read: oriented_id = 2 * key + strand, and its bases."""
    both = reads.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("strand"))
    return both.withColumns({"oriented_id": F.col(key) * 2 + F.col("strand"), bases: oriented(F.col(bases), F.col("strand"))})


def dna_view(docs: DataFrame) -> DataFrame:
    """Reads made of documents: letters a-z become A, C, G and T in turn, all else goes."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return docs.select(F.col("doc_id").alias("read_id"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("bases"))


def run_length_encode(reads: DataFrame) -> DataFrame:
    """One base a run and the run lengths; reads with a run of LONGEST_RUN or more are dropped."""
    runs = F.regexp_extract_all("bases", F.lit(r"(.)\1*"), F.lit(0))
    found = reads.withColumn("runs", runs)
    counts = F.transform("runs", lambda x: F.length(x))
    encoded = found.withColumn("counts", counts).where(~F.exists("counts", lambda n: n >= LONGEST_RUN))
    return encoded.withColumn("rle", F.array_join(F.transform("runs", lambda x: F.substring(x, 1, 1)), "")).drop("runs")


def run_length_decode(rle: Column, counts: Column) -> Column:
    """The raw bases of a run-length representation."""
    return F.array_join(F.zip_with(F.split(rle, ""), counts, lambda base, n: F.repeat(base, n.cast("int"))), "")


def raw_length(counts: Column) -> Column:
    """P4."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def raw_positions(encoded: DataFrame) -> DataFrame:
    """P5: (read_id, rle_position, raw_position) by a running sum over the runs."""
    runs = encoded.select("read_id", F.posexplode("counts").alias("rle_position", "n"))
    before = Window.partitionBy("read_id").orderBy("rle_position").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("read_id", "rle_position", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("raw_position"))


def metadata_value(meta: Column, key: str) -> Column:
    """The first non-empty value of `key` in space-separated key=value pairs, null if there is none."""
    return F.nullif(F.regexp_extract(meta, rf"(?:^|\s){key}=(\S+)", 1), F.lit(""))


def minimum_length(reads: DataFrame, least: int, length: str = "length") -> DataFrame:
    """The reads kept; the rest are reads.where(length < least)."""
    return reads.where(F.col(length) >= least)


def length_histogram(lengths: DataFrame, bin_width: int = 1, length: str = "length") -> DataFrame:
    """Reads and bases by length bin."""
    bin_ = (F.floor(F.col(length) / bin_width) * bin_width).cast("long")
    return lengths.groupBy(bin_.alias("bin")).agg(F.count("*").alias("reads"), F.sum(length).cast("long").alias("bases"))


def cumulative_lengths(lengths: DataFrame, length: str = "length") -> DataFrame:
    """By descending length, cumulative reads and bases and their fractions of the total.

    The window runs over the histogram, one row a distinct length, not over the reads.
    """
    histogram = lengths.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("reads"), (F.count("*") * F.first(length)).cast("long").alias("bases"))
    down = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return histogram.withColumns({
        "cumulative_reads": F.sum("reads").over(down), "cumulative_bases": F.sum("bases").over(down),
        "fraction": F.sum("bases").over(down) / F.sum("bases").over(everything),
    })


def read_n50(lengths: DataFrame, length: str = "length") -> DataFrame:
    """The largest length at which more than half of all bases are reached."""
    return cumulative_lengths(lengths, length).where("fraction > 0.5").agg(F.max("length").alias("n50"))


def assembly_statistics(segments: DataFrame, key: str, length: str) -> DataFrame:
    """Rank by length, cumulative length, and N50 as the first with half the total (integer division) or more.

    Equal lengths rank by key. The running sum is taken within range partitions of the sort, whose
    totals, one a partition, are added after.
    """
    down = [F.desc("length"), F.asc("key")]
    rows = segments.select(F.col(key).alias("key"), F.col(length).cast("long").alias("length"))
    dealt = rows.repartitionByRange(*down).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy(*down)
    dealt = dealt.withColumns({"r": F.row_number().over(within), "c": F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    totals = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.sum("s").over(everything).alias("total"))
    rows = dealt.join(totals, "part").select("key", "length", (F.col("r") + F.col("n0")).cast("long").alias("rank"), (F.col("c") + F.col("s0")).cast("long").alias("cumulative"), "total")
    return rows


def assembly_n50(segments: DataFrame, key: str, length: str) -> DataFrame:
    """One row with the count, total length and N50."""
    rows = assembly_statistics(segments, key, length)
    half = F.floor(F.col("total") / 2)
    return rows.agg(F.count("*").alias("segments"), F.max("total").cast("long").alias("total"), F.min_by(F.when(F.col("cumulative") >= half, F.col("length")), F.when(F.col("cumulative") >= half, F.col("rank"))).alias("n50"))


def coverage_cutoff(lengths: DataFrame, target: int, length: str = "length") -> DataFrame:
    """(cutoff): the last length dropped while more than `target` bases remain; 0 if there are fewer.

    Reads as long as the cutoff itself are kept by a later minimum_length(), as they are in the rule.
    """
    histogram = lengths.groupBy(F.col(length).cast("long").alias("length")).agg((F.count("*") * F.first(length)).cast("long").alias("bases"))
    upward = Window.orderBy("length").rowsBetween(0, Window.unboundedFollowing)
    kept = histogram.withColumn("remaining", F.sum("bases").over(upward))
    return kept.agg(F.coalesce(F.max(F.when(F.col("remaining") > target, F.col("length"))), F.lit(0)).cast("long").alias("cutoff"))


def same_channel_pairs(reads: DataFrame, keys: list[str], number: str, delta: int, id_column: str) -> DataFrame:
    """P10: pairs of different rows with equal, non-null `keys` whose `number`s differ by less than `delta`.

    A range join by bins of width `delta`: a row meets its own and the next bin only.
    """
    rows = reads.select(F.col(id_column).alias("id"), *keys, F.col(number).alias("number")).dropna()
    bin_ = F.floor(F.col("number") / delta)
    left = rows.select("id", *keys, "number", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"))
    right = rows.select(F.col("id").alias("id1"), *keys, F.col("number").alias("number1"), bin_.alias("bin"))
    pairs = left.join(right, [*keys, "bin"]).where((F.col("id") < F.col("id1")) & (F.abs(F.col("number") - F.col("number1")) < delta))
    return pairs.select(F.col("id").alias("id0"), "id1")


def suppress_candidates(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs without those of same_channel_pairs()."""
    return candidates.join(pairs, ["id0", "id1"], "left_anti")
