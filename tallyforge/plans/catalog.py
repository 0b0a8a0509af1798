"""All registered queries; importing this module registers them."""

from __future__ import annotations

from tallyforge.plans import ledger_queries, match_queries, output_queries, receipt_queries, statement_queries  # noqa: F401
from tallyforge.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
