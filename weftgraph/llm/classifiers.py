"""Quality (operator 1) and toxicity (operator 10) by ordinal regression on whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import ordinal
from weftgraph.llm.common import as_bytes, bound_batches, table

#: Labelled documents that a fit reads at most; all documents are scored.
QUALITY_ROWS = 6_000
TOXIC_ROWS = 12_000
#: A column must stand in so many toxic texts of the sample to carry a weight.
LEAST_SUPPORT = 4


def fit_quality(docs: DataFrame, labels: DataFrame, *, rows: int = QUALITY_ROWS, grade: str = "quality") -> ordinal.OrdinalModel:
    """Grades from hashed byte trigrams and shape buckets."""
    row, column, value, y = ordinal.labelled_sample(docs, labels, grade, rows, ordinal.quality_features)
    return ordinal.fit(row, column, value, y, ordinal.QUALITY_WIDTH, l2=2e-5)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = TOXIC_ROWS, grade: str = "toxic") -> ordinal.OrdinalModel:
    """Severity from the words and word beginnings that a text holds; evidence only ever raises it.

    Columns seen in fewer than LEAST_SUPPORT texts above the lowest grade, or there no more often than
    elsewhere by a clear margin, get no weight.
    """
    row, column, value, y = ordinal.labelled_sample(docs, labels, grade, rows, ordinal.word_features)
    if len(y) and y.max() > y.min():
        above = y > y.min()
        n1, n0 = above.sum(), (~above).sum()
        with_, without = (np.bincount(column[x], minlength=ordinal.WORDS) for x in (above[row], ~above[row]))
        kept = (with_ >= LEAST_SUPPORT) & ((with_ + 0.5) / (n1 + 1) > 4 * (without + 0.5) / (n0 + 1))
        used = kept[column]
        row, column, value = row[used], column[used], value[used]
    return ordinal.fit(row, column, value, y, ordinal.WORDS, l1=3e-5, l2=1e-6, rising=True, steps=300)


def grade_texts(docs: DataFrame, model: ordinal.OrdinalModel, score: Callable[[bytes, np.ndarray], float], cutoff: float, *, text: str = "text") -> DataFrame:
    """Add expected (grade) and tail (probability of at least `cutoff`) to every row of `docs`.

    One pass, no shuffle. A null text is graded as an empty one. Repeated rows get equal grades. Columns named
    expected or tail are replaced, others pass through.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed width
    kept = [c for c in docs.columns if c not in ("expected", "tail")]
    names = kept if text in kept else [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.array([score(x, model.weights) for x in as_bytes(batch.column(names.index(text)))])
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.expected(scores)), pa.array(model.tail(scores, cutoff))], [*names, "expected", "tail"])

    rows = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, expected double, tail double")


def quality(docs: DataFrame, labels: DataFrame, *, rows: int = QUALITY_ROWS, cutoff: float = 1.0, least: float = 0.5) -> DataFrame:
    """`docs` with expected, tail and keep: whether the grade is `cutoff` or better with probability `least`.

    With no labelled row there is nothing to judge by: expected is 0, tail 0 and every document is kept.
    """
    model = fit_quality(docs, labels, rows=rows)
    graded = grade_texts(docs, model, ordinal.quality_score, cutoff)
    return graded.withColumn("keep", (F.col("tail") >= least) | F.lit(len(model.grades) < 2))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = quality(docs, table(spark, sf_dir, "labels"))
    return graded.select("doc_id", F.col("expected").alias("expected_grade"), F.col("tail").alias("tail_probability"), "keep")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    graded = grade_texts(docs, model, ordinal.word_score, 1.0)
    return graded.select("doc_id", F.col("expected").alias("expected_severity"), F.col("tail").alias("toxic_probability"), (F.col("tail") >= 0.5).alias("toxic"))
