"""The whole way from reads to segments over all documents, as a query."""

from __future__ import annotations

from weftgraph import assembly as S
from weftgraph.operators import alignment
from weftgraph.operators.sequences import dna_view
from weftgraph.plans.common import table
from weftgraph.stages import Stages
from weftgraph.storage import new_path

#: Documents overlap where they copy each other, so a few reads make a vertex.
OPTIONS = S.AssemblyOptions(alignment=alignment.AlignOptions(min_aligned_markers=20), marker_graph=S.MarkerGraphOptions(min_coverage=3, min_edge_coverage=2))


def assembly_segments(spark, sf_dir):
    return S.assemble(dna_view(table(spark, sf_dir, "documents")), OPTIONS, Stages(spark, new_path(spark, "assembly")))


QUERIES = {"assembly_segments": assembly_segments}
