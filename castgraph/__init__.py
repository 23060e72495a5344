"""Relationship analytics between named entities of texts and plays, on Spark DataFrames."""
