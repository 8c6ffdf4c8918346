"""All registered queries."""

from gridtide.plans import (  # noqa: F401
    queries_files,
    queries_models,
    queries_quality,
    queries_series,
    queries_statistics,
    queries_tables,
    queries_weather,
)
from gridtide.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
