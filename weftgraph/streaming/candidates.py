"""Candidates of a stream of documents against an indexed set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lowhash import LowHashOptions, low_hashes


def feature_index(feats: DataFrame, options: LowHashOptions = LowHashOptions()) -> DataFrame:
    """(feature, oriented_id) of the low-hash features of a fixed set; buckets over max_bucket are left out, as in the batch search."""
    low = low_hashes(feats, options, [0]).select("feature", "oriented_id").distinct()
    small = low.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") <= options.max_bucket)
    return low.join(small.select("feature"), "feature", "left_semi")


def streaming_candidates(stream: DataFrame, index: DataFrame, m: int) -> DataFrame:
    """Stream-static join: (doc_id, oriented_id, feature) of each arriving document (doc_id, text) that shares a feature with the index.

    The m-grams of a document come from the document itself, so the query keeps no state.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - m + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, m), " "))
    rows = stream.select("doc_id", words.alias("words")).where(F.size("words") >= m).select("doc_id", F.explode(grams).alias("feature"))
    return rows.join(index, "feature").select("doc_id", "oriented_id", "feature")
