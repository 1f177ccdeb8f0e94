"""Concept-graph analytics as Spark jobs."""
