"""Lookups of single reads, pairs and markers, and the tables that reports are written from."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.alignment import align_sequences
from weftgraph.operators.kmers import reverse_complement
from weftgraph.operators.lowhash import common_members
from weftgraph.shipping import ship


def reads_by_name(reads: DataFrame, name: str, column: str = "name") -> DataFrame:
    """All reads of a name, which need not be unique. The filter reaches the scan."""
    return reads.where(F.col(column) == name)


def without_palindromes(rows: DataFrame, palindromes: DataFrame, column: str = "oriented_id") -> DataFrame:
    """Markers (or features) without those of the reads that alignment.palindromic() found, before candidates are looked for."""
    return rows.join(palindromes.select(F.col("oriented_id").alias(column)).distinct(), column, "left_anti")


def markers_of_read(markers: DataFrame, oriented_id: int) -> DataFrame:
    """One oriented read's markers; order by ordinal to list them."""
    return markers.where(F.col("oriented_id") == oriented_id)


def oriented_alignments(info: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Every alignment from both of its reads: (oriented_id, other, ...), with read 0's columns those of oriented_id.

    With `kept` (r0, r1), only these, as for the alignments of a read graph.
    """
    if kept is not None:
        info = info.join(kept.select("r0", "r1").distinct(), ["r0", "r1"], "left_semi")
    turn = {"r0": "r1", "r1": "r0", "n0": "n1", "n1": "n0", "first0": "first1", "first1": "first0", "last0": "last1", "last1": "last0"}
    back = info.select(*(F.col(turn.get(c, c)).alias(c) for c in info.columns))
    return info.unionByName(back).withColumnsRenamed({"r0": "oriented_id", "r1": "other"})


def stored_alignments(chains: DataFrame, a: int, b: int) -> DataFrame:
    """The stored alignments of a pair, whichever read comes first."""
    return chains.where(F.col("r0").isin(a, b) & F.col("r1").isin(a, b) & (F.col("r0") != F.col("r1")))


def aligned_markers(chains: DataFrame) -> DataFrame:
    """(oriented_id, ordinal, other, other_ordinal): what every marker is aligned to; filter by a marker to look it up.

    `chains` holds (r0, r1, o0, o1) of oriented reads; add alignment.reversed_strands() for the other strands.
    """
    one = chains.select(F.col("r0").alias("oriented_id"), F.col("o0").alias("ordinal"), F.col("r1").alias("other"), F.col("o1").alias("other_ordinal"))
    two = chains.select(F.col("r1").alias("oriented_id"), F.col("o1").alias("ordinal"), F.col("r0").alias("other"), F.col("o0").alias("other_ordinal"))
    return one.unionByName(two)


def aligned_coverage(chains: DataFrame) -> DataFrame:
    """(oriented_id, ordinal, n): how many alignments align each marker; markers that none aligns are left out."""
    return aligned_markers(chains).groupBy("oriented_id", "ordinal").agg(F.count("*").alias("n"))


def align_paths(paths: DataFrame, pairs: DataFrame, owner: str, segment: str) -> DataFrame:
    """(a, b, score, aligned, matches) of the pseudo-paths (owner, idx, segment) of each pair (a, b), with free end gaps.

    aligned counts the columns of the alignment, gaps included, matches those of equal segments. A pair is one row with both paths.
    """
    ship(paths.sparkSession)
    whole = paths.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", segment))), lambda x: x[segment]).alias("path"))
    rows = pairs.select("a", "b").distinct().join(whole.select(F.col(owner).alias("a"), F.col("path").alias("pa")), "a").join(whole.select(F.col(owner).alias("b"), F.col("path").alias("pb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["pa"], batch["pb"], strict=True):
                score, columns = align_sequences(list(x), list(y))
                out.append((a, b, score, len(columns), sum(p == q for p, q in columns)))
            yield pd.DataFrame(out, columns=["a", "b", "score", "aligned", "matches"])

    return rows.mapInPandas(run, "a long, b long, score long, aligned long, matches long")


def related_edges(members: DataFrame, edge: str, member: str) -> DataFrame:
    """(edge, related): edges that share a read, in both directions."""
    pairs = common_members(members, edge, member)
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias(edge), F.col("b").alias("related")), F.struct(F.col("b").alias(edge), F.col("a").alias("related")))).alias("e")).select("e.*")


def expanded_paths(edges: DataFrame) -> DataFrame:
    """(u, v) of a graph in which every edge (s0, s1, path) becomes a chain of its own through the segments of `path`.

    A vertex is a struct (segment, s0, s1, step); those of the graph itself have null for all but the segment.
    """
    end = lambda x: F.struct(F.col(x).alias("segment"), F.lit(None).cast("long").alias("s0"), F.lit(None).cast("long").alias("s1"), F.lit(None).cast("int").alias("step"))
    inner = F.transform("path", lambda x, i: F.struct(x.alias("segment"), F.col("s0").cast("long").alias("s0"), F.col("s1").cast("long").alias("s1"), i.cast("int").alias("step")))
    nodes = edges.select(F.concat(F.array(end("s0")), inner, F.array(end("s1"))).alias("n"))
    return nodes.select(F.explode(F.arrays_zip(F.slice("n", 1, F.size("n") - 1).alias("u"), F.slice("n", 2, F.size("n") - 1).alias("v"))).alias("e")).select("e.u", "e.v")


# ---- Tables of reports; sinks.write_csv() writes them --------------------------------------------------


def kmer_table(frequencies: DataFrame) -> DataFrame:
    """K8: (kmer, reverse, frequency)."""
    return frequencies.select("kmer", reverse_complement("kmer").alias("reverse"), "frequency")


def with_names(pairs: DataFrame, reads: DataFrame, ends: tuple[str, str] = ("r0", "r1"), key: str = "read_id", name: str = "name") -> DataFrame:
    """Candidates or read graph edges with the names of both reads (name0, name1)."""
    for i, end in enumerate(ends):
        pairs = pairs.join(reads.select(F.col(key).alias(end), F.col(name).alias(f"name{i}")), end, "left")
    return pairs


def reads_by_segment(path: DataFrame, visits: DataFrame) -> DataFrame:
    """(segment, edges, reads, oriented_id, n): of `path` (segment, eid) its edges, and how often each read of `visits` (eid, oriented_id) is on them."""
    edges = path.groupBy("segment").agg(F.countDistinct("eid").alias("edges"))
    on = path.distinct().join(visits, "eid").groupBy("segment", "oriented_id").agg(F.count("*").alias("n"))
    reads = on.groupBy("segment").agg(F.count("*").alias("reads"))
    return on.join(reads, "segment").join(edges, "segment").select("segment", "edges", "reads", "oriented_id", "n")


def component_sizes(parts: DataFrame) -> DataFrame:
    """(size, n): how many components of graph.connected_components() have each size."""
    return parts.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
