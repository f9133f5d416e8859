"""Spark-first document ETL, retrieval and chunking engine."""

__version__ = "0.1.0"
