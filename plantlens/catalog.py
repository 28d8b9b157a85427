"""Registered queries of the telemetry engine and their oracle SQL."""

from __future__ import annotations

from plantlens.plans import alert_queries, data_queries, detect_queries, long_queries, model_queries  # noqa: F401  they register
from plantlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
