"""All queries of the engine by name, each with its SQL for an independent engine."""

from __future__ import annotations

from campovia.plans import administered, dispatched, domain, flows, lists, relational, scalar  # noqa: F401  registers its queries
from campovia.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    """Every registered query."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of each query that SQL can express."""
    return dict(SQL)
