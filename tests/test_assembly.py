"""Named stages and the whole way from reads to segments."""

import random

import pytest

from weftgraph import assembly as S
from weftgraph.operators import alignment, lowhash
from weftgraph.stages import Stages


def test_a_second_session_resumes_after_a_killed_stage(spark, tmp_path):
    root, built = f"file://{tmp_path}/run", []

    def build(name, n):
        def go():
            built.append(name)
            if n is None:
                raise RuntimeError("killed")
            return spark.range(n).withColumnRenamed("id", name)

        return go

    first = Stages(spark, root)
    first.run("a", build("a", 3), options={"k": 1})
    first.run("b", build("b", 4), after=("a",))
    with pytest.raises(RuntimeError):
        first.run("c", build("c", None), after=("b",))
    spark.range(1).write.parquet(f"{root}/c-half")  # what a killed stage leaves behind
    again = Stages(spark.newSession(), root)
    assert again.names() == ["a", "b"] and again.options("a") == {"k": 1}
    assert again.run("a", build("a", 3), options={"k": 1}).count() == 3
    assert again.run("b", build("b", 4), after=("a",)).count() == 4
    assert again.run("c", build("c", 5), after=("b",)).count() == 5
    assert built == ["a", "b", "c", "c"]
    again.run("a", build("a", 6), options={"k": 2})  # another option: it and what comes after it are built anew
    assert again.run("b", build("b", 7), after=("a",)).count() == 7 and Stages(spark, root).open("b").count() == 7
    assert again.manifest().count() == 5 and again.sweep() == 3 and Stages(spark, root).open("c").count() == 5
    with pytest.raises(KeyError):
        again.open("nothing")


def reversed_(x):
    return x.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_reads_to_segments_in_one_call(spark, tmp_path):
    r = random.Random(12)
    genome = "".join(r.choice("ACGT") for _ in range(2000))
    reads = []
    for i in range(70):
        at = r.randrange(-200, 1850)
        piece = genome[max(at, 0) : at + r.randint(350, 500)]
        reads.append((i, piece if r.random() < 0.5 else reversed_(piece)))
    options = S.AssemblyOptions(
        kmers=S.KmerOptions(8, 0.25), candidates=lowhash.LowHashOptions(hash_fraction=0.2, max_bucket=200, min_frequency=1), alignment=alignment.AlignOptions(min_aligned_markers=12),
        read_graph=S.ReadGraphOptions(12), marker_graph=S.MarkerGraphOptions(min_coverage=3, min_edge_coverage=2), segments=S.SegmentOptions(bubbles=True),
    )
    df = spark.createDataFrame(reads, "read_id long, bases string")
    stages = Stages(spark, f"file://{tmp_path}/assembly")
    segments = S.assemble(df, options, stages).collect()
    longest = max(segments, key=lambda x: x.length)
    assert longest.sequence in genome or longest.sequence in reversed_(genome)
    assert sum(x.length for x in segments) > 1500 and longest.length > 700
    assert all(x.length == len(x.sequence) for x in segments)
    assert len({min(x.sequence, reversed_(x.sequence)) for x in segments}) == len(segments)
    before = stages.manifest().count()
    again = S.assemble(df, options, Stages(spark, stages.root)).collect()
    assert sorted(again) == sorted(segments) and stages.manifest().count() == before
    out = S.outputs(stages)
    assert out["fasta"].count() == len(segments) and out["statistics"].count() == len(segments) and out["gfa"].count() >= 1 + len(segments)
