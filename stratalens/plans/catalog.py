"""Importing this module registers every query."""

from stratalens.plans import (
    q_compare,
    q_design,
    q_flow,
    q_groups,
    q_harmonize,
    q_quality,
    q_replicates,
    q_scores,
    q_segments,
    q_sources,
    q_stream,
    q_variance,
)
from stratalens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
