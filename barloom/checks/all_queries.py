"""Imports every group of registered queries."""

from __future__ import annotations

from . import q_data, q_experiment, q_factors, q_folds, q_ledger, q_panel, q_research, q_verify  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
