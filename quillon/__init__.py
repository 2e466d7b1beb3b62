"""Retrieval, name-matching and conversation analytics expressed as Spark jobs."""
