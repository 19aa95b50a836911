"""Queries over the supplied tables, one module for each family of operators."""

from veridact.plans import (  # noqa: F401
    aggregate_queries,
    change_queries,
    code_queries,
    decision_queries,
    domain_queries,
    evidence_queries,
    feed_queries,
    find_queries,
    finding_queries,
    graph_queries,
    join_queries,
    lifecycle_queries,
    more_queries,
    ranking_queries,
    report_queries,
    source_queries,
    walk_queries,
)
from veridact.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
