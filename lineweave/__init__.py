"""Lineweave: diff-aware program-analysis relations and queries on Spark DataFrames."""
