"""Imports every plan module so that its queries register themselves."""

from ledgerloom.plans import allocation_queries, credit_queries, delay_queries, document_queries, forecast_queries, ledger_queries, model_queries, scenario_queries, screening_queries, statement_queries  # noqa: F401
from ledgerloom.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
