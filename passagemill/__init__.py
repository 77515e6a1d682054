"""Corpus retrieval and analytics on PySpark."""
