"""Lotloom: semi-structured trading lists as Spark DataFrames, from extraction to a match board."""
