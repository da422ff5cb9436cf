"""Every registered query over the given tables, and its SQL."""

from __future__ import annotations

from . import decision_plans, metric_plans, text_plans, thread_plans, vector_plans
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "decision_plans", "metric_plans", "text_plans", "thread_plans", "vector_plans"]
