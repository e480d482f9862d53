"""All registered queries over the reference tables."""

from __future__ import annotations

from tallymart.plans import q_checks, q_clean, q_profile, q_star  # noqa: F401
from tallymart.plans.registry import ORACLE_SQL, QUERIES

flagship = q_checks.flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
