"""Operators of a large-scale training-data pipeline, with their queries and SQL."""
