"""Rows of ``neighbors`` with the word of every row; see ``operators.neighbor_rows``."""

from motifloom.operators.neighbor_rows import SLICE, resolved_neighbors, slice_owner

__all__ = ["SLICE", "resolved_neighbors", "slice_owner"]
