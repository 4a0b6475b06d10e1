"""Queries over the driver's tables, each beside the SQL it must agree with."""

from fenloom.plans.registry import QUERIES, SQL

from fenloom.plans import (  # noqa: F401  (importing fills the registry)
    tidy,
    summaries,
    community,
    models,
    expression,
    ordination,
    reads,
    sources,
)

__all__ = ["QUERIES", "SQL"]
