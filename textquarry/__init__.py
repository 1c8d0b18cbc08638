"""Corpus indexing and retrieval expressed as Spark DataFrame operators."""
