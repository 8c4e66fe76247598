"""Verbatim-memory analytics as Spark jobs."""
