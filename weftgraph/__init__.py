"""Sequence-overlap and graph analytics on Spark DataFrames."""
