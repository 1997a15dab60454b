"""All queries over the reference operators."""

from leafmill.plans import more_queries, scalar_queries, store_queries, tree_queries  # noqa: F401
from leafmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
