"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from answerlab.plans import (  # noqa: F401
    q_balance,
    q_measures,
    q_runs,
    q_scoring,
    q_stats,
    q_text,
    q_vectors,
    q_votes,
)
from answerlab.plans.registry import QUERIES

__all__ = ["QUERIES"]
