"""Spark-first analytics over source-code metadata."""
