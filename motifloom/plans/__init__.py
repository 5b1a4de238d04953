"""Whole pipelines: rule mining and the neighbour graph."""
