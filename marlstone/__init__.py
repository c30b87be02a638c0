"""Spark-first analytics over versioned facts, text retrieval, portfolio risk and event streams."""
