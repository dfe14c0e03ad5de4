"""Spark-first analytics for large collections of feature-bearing items."""
