"""Streaming variants of batch operators."""
