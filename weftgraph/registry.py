"""All registered queries of the engine and their DuckDB SQL, by name."""

from __future__ import annotations

from weftgraph.plans import assembly, clusters, graphs, haplotypes, lookups, overlaps, reads, walks

QUERIES = {**reads.QUERIES, **overlaps.QUERIES, **graphs.QUERIES, **lookups.QUERIES, **walks.QUERIES, **clusters.QUERIES, **haplotypes.QUERIES, **assembly.QUERIES}
ORACLES = {**reads.ORACLES, **overlaps.ORACLES, **graphs.ORACLES, **lookups.ORACLES, **walks.ORACLES, **clusters.ORACLES, **haplotypes.ORACLES}
