"""Evolutionary sequence, tree and posterior-sample analytics on Spark DataFrames."""
