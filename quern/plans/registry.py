"""The registered queries of the engine and their SQL: importing the plans fills both tables."""

from __future__ import annotations

from quern.plans import kernels, queries, screens
from quern.plans.tables import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "kernels", "queries", "screens"]
