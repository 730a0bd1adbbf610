"""Spark-first analytics over (date, instrument) panels."""
