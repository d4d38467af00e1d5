"""Lookups, vertex upkeep and report tables on small cases."""

import random
from collections import defaultdict

import pytest

from weftgraph.operators import journeys as J
from weftgraph.operators import lookups as P
from weftgraph.operators import marker_graph as G
from weftgraph.operators.sinks import write_csv


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reads_and_pairs(spark):
    chains = spark.createDataFrame([(1, 2, 0, 5), (2, 3, 1, 1), (1, 2, 4, 9), (2, 2, 7, 7)], "r0 long, r1 long, o0 int, o1 int")
    assert rows(P.stored_alignments(chains, 2, 1)) == [(1, 2, 0, 5), (1, 2, 4, 9)]
    assert rows(P.aligned_markers(chains).where("oriented_id = 2 and ordinal = 5")) == [(2, 5, 1, 0)]
    info = spark.createDataFrame([(1, 2, 10, 20), (2, 3, 20, 30)], "r0 long, r1 long, n0 int, n1 int")
    assert rows(P.oriented_alignments(info, info.where("r0 = 1"))) == [(1, 2, 10, 20), (2, 1, 20, 10)]
    markers = spark.createDataFrame([(1, "A"), (2, "C"), (2, "G"), (None, "T")], "oriented_id long, kmer string")
    assert {r.kmer for r in P.without_palindromes(markers, spark.createDataFrame([(2,), (2,)], "oriented_id long")).collect()} == {"A", "T"}


def test_paths(spark):
    path = [(1, i, x) for i, x in enumerate("abcdef")] + [(2, i, x) for i, x in enumerate("bcxef")] + [(3, 0, "z")]
    df = spark.createDataFrame(path, "owner long, idx int, segment string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "a long, b long")
    got = P.align_paths(df, pairs, "owner", "segment").collect()
    assert [(r.a, r.b, r.matches) for r in got] == [(1, 2, 4)] and got[0].score == 4 * 6 - 1
    edges = spark.createDataFrame([(1, 2, [7, 8]), (1, 3, [])], "s0 long, s1 long, path array<long>")
    found = {(r.u.segment, r.u.step, r.v.segment, r.v.step) for r in P.expanded_paths(edges).collect()}
    assert found == {(1, None, 7, 0), (7, 0, 8, 1), (8, 1, 2, None), (1, None, 3, None)}


def test_tables_and_csv(spark, tmp_path):
    names = spark.createDataFrame([(1, "one"), (2, "two")], "read_id long, name string")
    pairs = P.with_names(spark.createDataFrame([(1, 2), (2, 9)], "r0 long, r1 long"), names)
    assert {(r.r0, r.r1, r.name0, r.name1) for r in pairs.collect()} == {(1, 2, "one", "two"), (2, 9, "two", None)}
    table = P.kmer_table(spark.createDataFrame([("AAC", 3)], "kmer string, frequency long"))
    write_csv(table, f"{tmp_path}/kmers")
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/kmers")) == [("AAC", "GTT", "3")]


def test_coverage_data(spark):
    vertices = spark.createDataFrame([(0, 2, 0), (0, 5, 1)], "vid long, oriented_id long, ordinal int")
    markers = spark.createDataFrame([(2, 0, "AC", [1, 3]), (5, 1, "AC", [2, 3])], "oriented_id long, ordinal int, kmer string, repeats array<int>")
    want = [(0, 0, "A", 0, 1, 1), (0, 0, "A", 1, 2, 1), (0, 1, "C", 0, 3, 1), (0, 1, "C", 1, 3, 1)]
    assert rows(G.vertex_coverage_data(vertices, markers)) == want


@pytest.mark.parametrize("distance", [1, 2])
def test_disconnecting_edges_equal_a_search(spark, distance):
    draw = random.Random(distance)
    edges = [(e, draw.randrange(24), draw.randrange(24)) for e in range(30)] + [(30, 1, 1), (31, 50, 51), (32, 60, 61), (33, 61, 60)]
    near = defaultdict(list)
    for e, s, t in edges:
        near[s].append((e, t))
        near[t].append((e, s))
    want = set()
    for e, s, t in edges:
        reached = {s}
        for _ in range(2 * distance):
            reached |= {y for x in reached for f, y in near[x] if f != e}
        if t not in reached:
            want.add(e)
    assert 0 < len(want) < len(edges)
    got = G.disconnecting_edges(spark.createDataFrame(edges, "eid long, src long, dst long"), distance)
    assert {r.eid for r in got.collect()} == want


def test_renumber(spark):
    df = spark.createDataFrame([(50, 1), (7, 2), (50, 3), (900, 4)], "vid long, oriented_id long")
    assert rows(G.renumber(df)) == [(0, 2), (1, 1), (1, 3), (2, 4)]
    assert G.renumber(df.limit(0)).count() == 0
