"""Evergrain: evidence folding, gated retrieval and dataset curation on Spark DataFrames."""
