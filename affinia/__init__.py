"""Spark-first analytics for catalogue, watch-history and keyword data."""
