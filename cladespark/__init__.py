"""Sequence, tree and posterior analytics over Spark DataFrames."""
