"""Spark-first analytics over recorded generative-model confidence data."""
