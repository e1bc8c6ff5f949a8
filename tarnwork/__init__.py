"""Corpus preparation, batch retrieval and evaluation as Spark jobs."""
