"""All registered queries, collected from the modules that define them."""

from tenderglow.plans import (  # noqa: F401
    queries_columns,
    queries_records,
    queries_sources,
    queries_streams,
)
from tenderglow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
