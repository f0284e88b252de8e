"""Corpus indexing, search and training-data preparation as Spark jobs."""
