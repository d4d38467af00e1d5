"""From reads to segments in one call, stage by stage, each recorded by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import alignment as A
from weftgraph.operators import assembly_graph as B
from weftgraph.operators import consensus as N
from weftgraph.operators import kmers as K
from weftgraph.operators import lowhash as J
from weftgraph.operators import marker_graph as G
from weftgraph.operators import phasing as D
from weftgraph.operators import read_graph as R
from weftgraph.operators import sequences as P
from weftgraph.operators import sinks as W
from weftgraph.stages import Stages


@dataclass(frozen=True)
class ReadOptions:
    """Reads shorter than min_length are left out; `version` names the input, so that another one is another stage."""

    min_length: int = 0
    version: str = ""


@dataclass(frozen=True)
class KmerOptions:
    """Markers: k bases, each k-mer chosen with its reverse complement by its hash."""

    k: int = 10
    probability: float = 0.1


@dataclass(frozen=True)
class ReadGraphOptions:
    """Alignments kept for each read."""

    max_alignments: int = 6


@dataclass(frozen=True)
class MarkerGraphOptions:
    """Bounds of vertices, and clean-up of edges."""

    min_coverage: int = 10
    max_coverage: int = 100
    min_per_strand: int = 0
    min_edge_coverage: int = 1
    prune_iterations: int = 6


@dataclass(frozen=True)
class SegmentOptions:
    """Assembled segments: shorter ones are left out; edges whose reads are farther apart are called by the shortest; bubbles on request."""

    min_length: int = 0
    longest_edge: int = 10_000
    bubbles: bool = False


@dataclass(frozen=True)
class AssemblyOptions:
    """The options of every stage; sources.read_options() fills each part from a file's section."""

    reads: ReadOptions = ReadOptions()
    kmers: KmerOptions = KmerOptions()
    candidates: J.LowHashOptions = field(default_factory=J.LowHashOptions)
    alignment: A.AlignOptions = field(default_factory=A.AlignOptions)
    read_graph: ReadGraphOptions = ReadGraphOptions()
    marker_graph: MarkerGraphOptions = MarkerGraphOptions()
    segments: SegmentOptions = SegmentOptions()


def oriented_pairs(pairs: DataFrame) -> DataFrame:
    """(r0, r1) of oriented reads to align: the first read of a candidate (r0, r1, same_strand) on strand 0, the other as it lies to it."""
    return pairs.select((F.col("r0") * 2).alias("r0"), (F.col("r1") * 2 + F.when(F.col("same_strand"), 0).otherwise(1)).cast("long").alias("r1"))


def on_both_strands(chains: DataFrame) -> DataFrame:
    """Alignments (r0, r1, o0, o1, n0, n1) of oriented reads, and the same on their other strands."""
    turned = A.reversed_strands(chains).withColumns({"r0": F.col("r0").bitwiseXOR(F.lit(1).cast("long")), "r1": F.col("r1").bitwiseXOR(F.lit(1).cast("long"))})
    return chains.unionByName(turned.select(chains.columns))


def marker_intervals(edges: DataFrame, markers: DataFrame, strands: DataFrame, k: int) -> DataFrame:
    """(src, dst, overlap, sequence): what each read of an edge has between its two markers, as bases or as an overlap of the markers."""
    spans = edges.select("src", "dst", F.explode("intervals").alias("i")).select("src", "dst", "i.oriented_id", "i.o0", "i.o1")
    at = lambda o, p: markers.select("oriented_id", F.col("ordinal").cast("int").alias(o), F.col("position").alias(p))
    placed = spans.join(at("o0", "p0"), ["oriented_id", "o0"]).join(at("o1", "p1"), ["oriented_id", "o1"]).join(strands, "oriented_id")
    gap = F.col("p1") - F.col("p0") - k
    return placed.select("src", "dst", F.when(gap < 0, -gap).otherwise(0).cast("int").alias("overlap"), F.when(gap > 0, F.substring("bases", F.col("p0") + k + 1, gap)).otherwise(F.lit("")).alias("sequence"))


def segment_pieces(compressed: DataFrame, edges: DataFrame, called: DataFrame, vertices: DataFrame) -> DataFrame:
    """The vertices and edges of every chain in order, as consensus.assemble_segments() takes them."""
    steps = compressed.select("chain", F.posexplode("path").alias("position", "eid")).join(edges.select("eid", "src", "dst", "coverage"), "eid").join(called, ["src", "dst"])
    first = steps.where("position = 0").select("chain", F.lit(0).alias("position"), F.col("src").alias("vid"))
    later = steps.select("chain", (2 * F.col("position") + 2).alias("position"), F.col("dst").alias("vid"))
    nodes = first.unionByName(later).join(vertices, "vid").select("chain", "position", F.lit("vertex").alias("kind"), F.col("kmer").alias("sequence"), F.col("coverage").cast("long").alias("coverage"), F.lit(0).alias("overlap"))
    between = steps.select("chain", (2 * F.col("position") + 1).alias("position"), F.lit("edge").alias("kind"), "sequence", F.col("coverage").cast("long").alias("coverage"), "overlap")
    return nodes.unionByName(between)


def assemble(reads: DataFrame, options: AssemblyOptions, stages: Stages) -> DataFrame:
    """(segment, sequence, length, markers, coverage): the segments of reads (read_id, bases), one of each reverse complement pair.

    Every stage is written under its name in `stages` with its options: reads, kmers, markers, candidates, aligned, kept, vertices, edges, chains, called, segments. A
    second call with the same options reopens what is there; with other options of a stage, that stage and those after it are built anew. Strands are
    paired throughout: markers, alignments and edges are made for both, so segments come in pairs.
    """
    o = options
    k = o.kmers.k
    read = stages.run("reads", lambda: reads.select(F.col("read_id").cast("long").alias("read_id"), F.coalesce("bases", F.lit("")).alias("bases")).where(F.length("bases") >= o.reads.min_length), options=o.reads)
    strands = stages.run("strands", lambda: P.with_both_strands(read, "read_id", "bases").select("oriented_id", "bases"), after=("reads",))
    selected = stages.run("kmers", lambda: K.select_random(K.kmer_frequency(read, k).select("kmer"), o.kmers.probability), options=o.kmers, after=("reads",))
    markers = stages.run("markers", lambda: K.find_markers(read, selected, k), options=o.kmers, after=("reads", "kmers"))
    found = stages.run("candidates", lambda: J.candidates(markers, o.candidates, stranded=True), options=o.candidates, after=("markers",))
    aligned = stages.run("aligned", lambda: A.compute_alignments(oriented_pairs(found), markers, o.alignment), options=o.alignment, after=("candidates",))

    def kept_alignments() -> DataFrame:
        good = A.filter_alignments(A.alignment_metrics(aligned), o.alignment)
        ranked = good.select(F.floor(F.col("r0") / 2).alias("u"), F.floor(F.col("r1") / 2).alias("v"), F.xxhash64("r0", "r1").alias("aid"), "markers", "r0", "r1")
        best = R.top_k_edges(ranked, o.read_graph.max_alignments).select("r0", "r1").distinct()
        return on_both_strands(aligned.join(best, ["r0", "r1"], "left_semi"))

    kept = stages.run("kept", kept_alignments, options=[o.alignment.__dict__, o.read_graph.__dict__], after=("aligned",))
    m = o.marker_graph
    vertices = stages.run("vertices", lambda: G.create_vertices(kept, min_coverage=m.min_coverage, max_coverage=m.max_coverage, min_per_strand=m.min_per_strand, stranded=True), options=m, after=("kept",))

    def clean_edges() -> DataFrame:
        made = G.create_edges(vertices).where(F.col("coverage") >= m.min_edge_coverage)
        return G.prune_leaves(made, m.prune_iterations).withColumn("eid", F.monotonically_increasing_id())

    edges = stages.run("edges", clean_edges, options=m, after=("vertices",))
    chains = stages.run("chains", lambda: B.compress(edges.select("eid", "src", "dst")), after=("edges",))
    if o.segments.bubbles:
        stages.run("bubbles", lambda: D.gather_bubbles(chains.select(F.col("chain").alias("eid"), "src", "dst")), after=("chains",))
    called = stages.run("called", lambda: N.edge_consensus(marker_intervals(edges, markers, strands, k), "src", "dst", longest=o.segments.longest_edge), options=o.segments, after=("edges",))

    def build() -> DataFrame:
        own = vertices.join(markers.select("oriented_id", "ordinal", "kmer"), ["oriented_id", "ordinal"]).groupBy("vid").agg(F.min("kmer").alias("kmer"), F.count("*").alias("coverage"))
        told = N.assemble_segments(segment_pieces(chains, edges, called, own), "chain")
        sized = chains.select("chain", F.col("length").cast("long").alias("markers"), F.posexplode("path").alias("i", "eid")).join(edges.select("eid", "coverage"), "eid").groupBy("chain", "markers").agg(F.round(F.avg("coverage"), 3).alias("coverage"))
        both = told.join(sized, "chain").where(F.length("sequence") >= o.segments.min_length)
        # of a segment and its reverse complement, equal up to strand, the one that comes first
        canonical = F.least("sequence", P.reverse_complement("sequence"))
        copy = F.row_number().over(Window.partitionBy("sequence").orderBy("chain"))
        own_reverse = F.col("sequence") == P.reverse_complement("sequence")  # such a pair has one sequence
        one = both.withColumn("copy", copy).where((F.col("sequence") == canonical) & (~own_reverse | (F.col("copy") % 2 == 1)))
        return one.select(F.col("chain").alias("segment"), "sequence", F.length("sequence").cast("long").alias("length"), "markers", "coverage")

    return stages.run("segments", build, options=o.segments, after=("chains", "called"))


def outputs(stages: Stages) -> dict[str, DataFrame]:
    """FASTA lines, GFA lines and statistics of assembled segments, from the stages alone."""
    segments = stages.open("segments")
    ends = stages.open("chains").select("chain", "src", "dst").join(segments.select(F.col("segment").alias("chain")), "chain")
    links = ends.select(F.col("chain").alias("from_id"), F.col("dst").alias("v")).join(ends.select(F.col("chain").alias("to_id"), F.col("src").alias("v")), "v")
    links = links.select("from_id", "to_id", F.lit("+").alias("from_strand"), F.lit("+").alias("to_strand"), F.lit("0M").alias("cigar"))
    return {
        "fasta": W.fasta_lines(segments, "segment"), "gfa": W.gfa_lines(segments.select(F.col("segment").alias("id"), "sequence", F.col("coverage").cast("long").alias("reads")), links),
        "statistics": P.assembly_statistics(segments, "segment", "length"),
    }
