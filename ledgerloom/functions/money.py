"""Money as whole ten-thousandths of a currency unit.

Sums of whole numbers do not depend on the order in which partitions arrive, so
balances are the same on one core and on a thousand executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10_000


def units(amount: Column | str) -> Column:
    """Amount (double or decimal) -> whole ten-thousandths."""
    return F.round(F.col(amount) * UNITS if isinstance(amount, str) else amount * UNITS).cast("long")


def amount(whole: Column | str) -> Column:
    """Whole ten-thousandths -> double amount."""
    col = F.col(whole) if isinstance(whole, str) else whole
    return col.cast("double") / F.lit(float(UNITS))


def sum_units(col: Column | str) -> Column:
    return F.sum(units(col))


def cents(col: Column | str) -> Column:
    """Two-place amount -> whole hundredths."""
    return F.round((F.col(col) if isinstance(col, str) else col) * 100).cast("long")
