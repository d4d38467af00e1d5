"""FASTA and FASTQ scans and k-mer lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.storage import materialize

FASTA = ("fasta", "fa", "FASTA", "FA")
FASTQ = ("fastq", "fq", "FASTQ", "FQ")


def _header(header: Column) -> tuple[Column, Column]:
    name = F.regexp_extract(header, r"^(\S*)", 1)
    return name, F.nullif(F.regexp_replace(header, r"^\S*\s*", ""), F.lit(""))


def read_fasta(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(name, meta, bases, length) of the records of FASTA files.

    A record starts at '>' at a line's start, so '\\n>' parts records and any number of tasks scan one file. White space
    inside a sequence goes; a read with an invalid base is dropped, and so is one shorter than min_length.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"^>", "")
    rows = raw.select(F.regexp_extract(record, r"^([^\n]*)", 1).alias("header"), F.upper(F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "")).alias("bases"))
    name, meta = _header(F.regexp_replace(F.col("header"), r"\r$", ""))
    kept = rows.where((F.col("header") != "") & F.col("bases").rlike("^[ACGT]*$") & (F.length("bases") >= min_length))
    return kept.select(name.alias("name"), meta.alias("meta"), "bases", F.length("bases").cast("long").alias("length"))


def read_fastq(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(name, meta, bases, length) of FASTQ files of strictly four lines a read; any violation is an error.

    The third line may go on after its '+'; qualities are checked for length only. Only a header and a quality may start with '@', so
    '\\n@' parts a file into pieces of four lines, or of three and one where the quality starts so, and any number of tasks scan one file.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    raw = spark.read.option("lineSep", "\n@").text(path).select("value", *place)
    # one row a block of a file: where its pieces begin and end
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    by = Window.partitionBy("file").orderBy("block")
    blocks = materialize(blocks.select("*", F.lead("block").over(by).alias("next_block"), F.lead("low").over(by).alias("next_low"), (F.row_number().over(by) == 1).alias("head")), "blocks")
    placed = raw.join(F.broadcast(blocks), ["file", "block"], "left")  # one row a block
    other = F.raise_error(F.lit("the FASTQ file, or how it is split, has changed since its blocks were listed")).cast("boolean")
    first, last = F.col("head") & (F.col("id") == F.col("low")), F.col("next_block").isNull() & (F.col("id") == F.col("high"))
    text = F.when(last, F.regexp_replace("value", r"\n$", "")).otherwise(F.col("value"))
    empty = first & last & (text == "")
    headless = first & ~text.startswith("@")
    lines = F.split(F.when(first, F.substring(text, 2, 1 << 30)).otherwise(text), "\n")
    rows = placed.where(F.when(F.coalesce(F.col("id").between(F.col("low"), F.col("high")), F.lit(False)), ~empty).otherwise(other)).select("file", "block", "id", "high", "next_block", "next_low", headless.alias("headless"), lines.alias("lines"))
    n = F.size("lines")
    odd = rows.where(n != 4).select(
        "file", "block", "id", "high", "next_block", "next_low", n.alias("n"), F.when(n == 3, F.length(F.get("lines", F.lit(1)))).otherwise(F.length(F.get("lines", F.lit(0))) + 1).alias("length"),
    )
    odd = materialize(odd, "odd_pieces")
    more = F.col("id") < F.col("high")
    opened = odd.where("n = 3").select("file", F.when(more, F.col("block")).otherwise(F.col("next_block")).alias("block"), F.when(more, F.col("id") + 1).otherwise(F.col("next_low")).alias("id"), F.col("length").alias("bases"))
    paired = opened.join(odd.where("n = 1").select("file", "block", "id", F.col("length").alias("quality")), ["file", "block", "id"], "full").where("bases is null or quality is null or bases != quality")
    wrong = paired.select("file").unionByName(odd.where("n not in (1, 3)").select("file"))
    at = lambda k: F.get("lines", F.lit(k))
    bases = F.upper(at(1))
    bad = F.col("headless") | ~at(2).startswith("+") | ((n == 4) & (F.length(at(1)) != F.length(at(3)))) | ~bases.rlike("^[ACGT]*$")
    found = rows.where(n.isin(3, 4)).select(at(0).alias("header"), F.when(bad, F.raise_error(F.concat(F.lit("bad FASTQ read "), at(0)))).otherwise(bases).alias("bases"))
    name, meta = _header(F.col("header"))
    kept = found.where(F.length("bases") >= min_length).select(name.alias("name"), meta.alias("meta"), "bases", F.length("bases").cast("long").alias("length"))
    stop = F.raise_error(F.concat(F.lit("a FASTQ file needs four lines a read, and a quality as long as its bases: "), F.col("file"))).cast("string")
    none = wrong.where(stop.isNotNull()).select(*(F.lit(None).cast(kind).alias(c) for c, kind in kept.dtypes))
    return kept.unionByName(none)


def load_reads(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """Read a file or folder by its extension; any other extension is an error."""
    extension = path.rstrip("/").rpartition(".")[2]
    if extension in FASTA:
        return read_fasta(spark, path, min_length)
    if extension in FASTQ:
        return read_fastq(spark, path, min_length)
    raise ValueError(f"not a FASTA or FASTQ file: {path}")


def read_kmer_list(spark: SparkSession, path: str) -> DataFrame:
    """(kmer), one a line; operators.kmers.select_listed() checks them."""
    return spark.read.text(path).select(F.trim("value").alias("kmer")).where("kmer != ''")


PAF = (
    "query string, query_length long, query_start long, query_end long, strand string, target string, target_length long, "
    "target_start long, target_end long, matches long, block_length long, quality int"
)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """The twelve fixed columns of PAF files."""
    return spark.read.csv(path, sep="\t", schema=PAF)


def overlapping_intervals(intervals: DataFrame, width: int = 10_000) -> DataFrame:
    """(region, a, b): pairs of intervals (region, id, start, stop) with a.start < b.stop and b.start < a.stop.

    Each interval goes to the bins it touches, and a pair is made in the bin where the later one starts.
    """
    binned = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("stop"), F.col("start") + 1) - 1) / width))))
    a = binned.select("region", "bin", F.col("id").alias("a"), F.col("start").alias("sa"), F.col("stop").alias("ea"))
    b = binned.select("region", "bin", F.col("id").alias("b"), F.col("start").alias("sb"), F.col("stop").alias("eb"))
    both = a.join(b, ["region", "bin"]).where("a < b and sa < eb and sb < ea")
    return both.where(F.floor(F.greatest("sa", "sb") / width) == F.col("bin")).select("region", "a", "b")
