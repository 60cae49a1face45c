"""Spark-first analytics over string key-value data kept as an append log."""
