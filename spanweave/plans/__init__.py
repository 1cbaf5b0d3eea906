"""Whole pipelines, and the queries that are registered."""
