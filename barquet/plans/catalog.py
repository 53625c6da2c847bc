"""All registered queries."""

from barquet.plans import (  # noqa: F401
    q_extension, q_index, q_ingest, q_ledger, q_news, q_pit, q_portfolio, q_signals, q_streaming,
)
from barquet.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
