"""Ranked retrieval over impact-ordered inverted indexes, as Spark jobs."""
