"""Every registered query of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from tilewright.plans import archives, features, files, inventory, metrics, recode, responses, style, tiles  # noqa: F401
from tilewright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
