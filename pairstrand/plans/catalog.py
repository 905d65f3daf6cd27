"""All graph queries, registered, and the SQL they are held against."""

from pairstrand.plans import structure_queries, walk_queries, whole_queries  # noqa: F401
from pairstrand.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
