"""All registered queries, gathered from their modules."""

from erario.plans import queries_ingest, queries_operations, queries_runs, queries_search, queries_tables  # noqa: F401
from erario.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
