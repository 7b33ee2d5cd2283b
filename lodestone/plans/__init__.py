"""Pipelines and queries built from the operators."""
