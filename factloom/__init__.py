"""Spark-first review of source text and preparation of training data."""
