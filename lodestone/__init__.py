"""Retrieval analytics over document and source corpora, expressed as Spark DataFrames."""
