"""All queries of the engine."""

from tessera.plans import graph_queries, query_queries, run_queries, search_queries, text_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
