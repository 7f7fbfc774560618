"""Retrieval evaluation on Spark: chunking, lexical and vector search, rank fusion, metrics, judging and reports."""

__version__ = "0.1.0"
