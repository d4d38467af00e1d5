"""The lexical index is written shard by shard."""

from pathlib import Path

import pyarrow.parquet as pq

from weftgraph import storage
from weftgraph.llm import lexical


def test_each_shard_is_a_row_group(spark, monkeypatch):
    groups = {}

    def spied(df, label="stage", **options):
        out = storage.materialize(df, label, **options)
        files = [pq.ParquetFile(x) for x in Path(storage._WRITTEN[out].removeprefix("file://")).glob("*.parquet")]
        groups[label] = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
        return out

    monkeypatch.setattr(lexical, "materialize", spied)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i}") for i in range(60)], "doc_id long, text string").repartition(1)
    items = spark.createDataFrame([(0, "w1 w2")], "item_id long, text string")
    assert lexical.ranked_search(docs, items, shard_terms=9).count() == 20
    assert groups["counted"] == groups["impacts"] == [1] * 20
