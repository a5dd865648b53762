"""Loads every module that registers queries."""

from signalfold.plans import (  # noqa: F401
    alert_queries,
    issue_queries,
    metric_queries,
    performance_queries,
    search_queries,
    signal_queries,
    streaming_queries,
    text_queries,
)
from signalfold.plans.registry import ORACLES, QUERIES  # noqa: F401
