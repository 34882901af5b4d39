"""All registered queries. Importing a query module registers it."""

from __future__ import annotations

from campuspulse.plans import (  # noqa: F401
    activity_queries, course_queries, ml_queries, source_queries, stats_queries, stream_queries,
)
from campuspulse.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
