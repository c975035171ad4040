"""Domain schemas, allowed values and cross-field rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Records of either ingestion channel.
RECORDS = (
    "record_id string, kind string, business_id long, amount decimal(28,2), due_date date, settled_date date, counterparty_name string, "
    "category string, is_receivable boolean, certainty double, source_type string, source_reference string"
)
# Allowed values of enumerated columns (fixed values).
ALLOWED = {
    "flexibility": ("rigid", "moderate", "flexible"),
    "zone": ("safe", "grey", "distress"),
    "action_type": ("pay_now", "pay_partial", "defer"),
    "convention": ("separate_debit_credit", "signed_single_column", "amount_with_indicator"),
}


def link_violation() -> Column:
    """A payable may not point at an inflow, nor a receivable at an outflow."""
    return F.when((F.col("direction") == "payable") & F.col("inflow_id").isNotNull(), "payable cannot link an inflow").when(
        (F.col("direction") == "receivable") & F.col("outflow_id").isNotNull(), "receivable cannot link an outflow"
    )
