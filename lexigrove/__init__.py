"""Hybrid retrieval and ranking of query documents against a catalogue, planned as Spark DataFrames."""
