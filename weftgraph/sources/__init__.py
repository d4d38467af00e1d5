"""Readers of sequence and model files."""
