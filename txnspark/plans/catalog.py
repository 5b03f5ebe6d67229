"""Importing this module registers every query."""

from txnspark.plans import (  # noqa: F401
    queries_sources,
    queries_features,
    queries_aggregates,
    queries_windows,
    queries_joins,
    queries_models,
    queries_runs,
    queries_streams,
)
from txnspark.plans.registry import ORACLES, QUERIES  # noqa: F401
