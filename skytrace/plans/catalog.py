"""All registered queries of the library, with their SQL."""

from . import grid_queries, history_queries, layer_queries, sequence_queries, stat_queries, track_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
