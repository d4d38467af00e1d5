"""Scalar functions on sequences, as Spark column expressions."""

from weftgraph.operators.alignment import edit_distance, overlap_length
from weftgraph.operators.kmers import canonical, is_run_length_kmer, stable_hash
from weftgraph.operators.phasing import common_prefix
from weftgraph.operators.sequences import metadata_value, oriented, raw_length, reverse_complement, run_length_decode

__all__ = [
    "canonical", "common_prefix", "edit_distance", "is_run_length_kmer", "metadata_value", "oriented", "overlap_length", "raw_length",
    "reverse_complement", "run_length_decode", "stable_hash",
]
