"""Subpackage of the Spark memory engine."""
