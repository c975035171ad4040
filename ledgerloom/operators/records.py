"""One table of inflows and outflows from receipts and bank statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import RECORDS

COLUMNS = [field.split()[0] for field in RECORDS.split(", ")]


def in_shape(rows: DataFrame, **values: object) -> DataFrame:
    """Rows as records: columns of their own by name, the others from ``values`` (a column or a constant) or null, all cast to the schema."""
    out = []
    for field in RECORDS.split(", "):
        name, kind = field.split()
        given = values.get(name, name if name in rows.columns else None)
        column = F.col(given) if isinstance(given, str) else F.lit(given) if given is None or isinstance(given, (bool, float)) else given
        out.append(column.cast(kind).alias(name))
    return rows.select(*out)


def receipt_records(reviewed: DataFrame) -> DataFrame:
    """Receipts that were recovered, as outflows to their vendor that are due and not yet settled.

    ``reviewed`` keeps business_id, vendor_name and category; receivable and certainty are of inflows alone.
    """
    good = reviewed.filter(F.col("reject_reason").isNull())
    name = F.concat(F.lit("receipt-"), F.col("doc_id").cast("string"))
    return in_shape(good, record_id=name, kind=F.lit("out"), counterparty_name="vendor_name", category=F.coalesce("category", F.lit("uncategorized")), source_type=F.lit("receipt"))


def statement_records(records: DataFrame) -> DataFrame:
    """Statement rows: money that has moved, so there is no due date, and an inflow is certain and no receivable."""
    return in_shape(records, due_date=None)


def records_union(reviewed: DataFrame, records: DataFrame) -> DataFrame:
    """Both channels in one shape; no row is matched or dropped here."""
    return receipt_records(reviewed).unionByName(statement_records(records))
