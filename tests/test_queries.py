"""Registered queries against their DuckDB SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "metadata_lookup", "length_n50", "assembly_n50", "coverage_cutoff", "same_channel_pairs", "lowhash_candidates", "alignment_metrics", "marker_edges", "prune_leaves",
    "secondary_edges", "back_segments", "jaccard_graph", "follow", "superbubble_verdicts", "snippet_clusters", "transfer", "phased_sequences", "phased_gfa", "linear_chains", "tangle_solvable", "consensus_bayesian", "phase_scores", "segment_journeys", "segment_pairs", "gfa_lines", "run_length_cigar",
]


def plain(rows):
    return Counter(tuple("null" if x is None or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in rows)


#: WEFTGRAPH_ALL_SQL=1 holds every query that has SQL against it.
NAMES = sorted(entry.oracle_sql()) if os.environ.get("WEFTGRAPH_ALL_SQL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    order = [got.columns.index(c) for c in columns]
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(tuple(r[i] for i in order) for r in got.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
