"""All queries of the engine with their SQL."""

from __future__ import annotations

from lexiloom.plans import channels, controls, experiments, features, joins, lexical, measures, readers, sequences  # noqa: F401
from lexiloom.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
