"""All queries of the engine."""

from glyphframe.plans import pixel_queries, scalar_queries, timeline_queries  # noqa: F401
from glyphframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
