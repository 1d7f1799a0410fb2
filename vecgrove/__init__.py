"""Approximate nearest-neighbour search over large vector collections, on Spark DataFrames."""
