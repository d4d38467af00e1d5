"""A training corpus from `documents`: five stages, each by one of the llm operators."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.classifiers import quality
from weftgraph.llm.common import small_enough, table
from weftgraph.llm.decontaminate import contamination
from weftgraph.llm.mixing import mix, word_count
from weftgraph.llm.simhash import similar_documents
from weftgraph.llm.suffix_dedup import remove_repeats
from weftgraph.storage import collected, discard, materialize, remove

#: The near-duplicate stage: links of at least this Jaccard similarity of the sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps (operator 1)."""
    return quality(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """`docs` with a number of its own for every row (__row), written so that it stays."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), label)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, of each group of near copies (operator 5's search, each link verified)."""
    rows = numbered(docs, "numbered")
    groups = materialize(similar_documents(rows, key="__row", shingle=SHINGLE, similarity=SIMILARITY), "groups")
    placed = groups.join(rows.select("__row", "doc_id"), "__row").select("__row", "component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("place"))
    first = placed.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("members")).where("members > 1")
    gone = materialize(placed.join(first, "component").where("place > first").select("__row"), "gone")
    return rows.join(small_enough(gone, 16), "__row", "left_anti").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of 100 bytes or more that an earlier document holds (operator 7), cut at whole characters.

    A document of which nothing is left goes.
    """
    cut = remove_repeats(docs, whole_characters=True).where("n_removed = 0 or octet_length(kept) > 0")
    cut = cut.withColumn("text", F.col("kept").cast("string"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows (operator 8)."""
    rows = numbered(docs, "numbered")
    judged = materialize(contamination(rows, table(spark, sf_dir, "benchmark"), key="__row"), "contamination")
    gone = judged.where("contaminated").select(F.col("doc_id").alias("__row"))
    return rows.join(small_enough(gone, 16), "__row", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator 4): the columns of documents, copy (from 1), size, source_size and target.

    Every row is taken by its own number, repeated rows too. The four columns replace others of these names.
    """
    kept = [c for c in docs.columns if c not in ("copy", "size", "source_size", "target")]
    rows = numbered(docs.select(*kept), "numbered")
    mixed = mix(rows.select("doc_id", "source", word_count("text").alias("size"), "__row"))
    new = ("copies", "size", "source_size", "target")
    taken = materialize(mixed.where("copies > 0").select("__row", *(F.col(c).alias(f"__{c}") for c in new)), "taken")
    joined = rows.join(small_enough(taken, 40), "__row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return joined.select(*kept, "copy", *(F.col(f"__{c}").alias(c) for c in new[1:]))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Paths of the tables that the last stages of a session wrote for themselves.
_LEFT: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def sweep(spark: SparkSession, reading: DataFrame | None = None) -> None:
    """Delete what the stages of STAGES that ran before left, but for tables that `reading` still reads."""
    left = _LEFT.pop(spark, [])
    files = reading.inputFiles() if reading is not None and left else []
    used = [x for x in left if any(f"/{x.rpartition('/')[2]}/" in f for f in files)]
    for path in set(left).difference(used):
        remove(spark, path)
    if used:
        _LEFT[spark] = used


def swept(stage: Stage) -> Stage:
    """`stage`, which before it begins deletes the tables of stages before it: their results have been written by then, or are what it reads."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, docs)
        with collected() as paths:
            out = stage(spark, docs, sf_dir)
        _LEFT[spark] = [*_LEFT.get(spark, []), *paths]
        return out

    return run


#: The result of one is written before the next begins, see swept().
STAGES = [
    ("quality", swept(quality_stage)),
    ("near_duplicates", swept(near_duplicate_stage)),
    ("repeats", swept(repeats_stage)),
    ("decontamination", swept(decontamination_stage)),
    ("mixing", swept(mixing_stage)),
]

#: Fits, components and byte-level cuts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    sweep(spark)
    return docs
