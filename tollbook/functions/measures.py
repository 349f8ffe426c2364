"""Counts, sums and means with one meaning of NULL everywhere.

Amounts are summed as decimals and turned into doubles once, at the output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

USAGE_OPERATIONS = (1, 2, 3)


def rows() -> Column:
    return F.count(F.lit(1))


def rows_where(condition: Column) -> Column:
    return F.count_if(condition)


def total(amount: Column) -> Column:
    """Sum as double; NULL where there is no value."""
    return F.sum(amount).cast("double")


def total_or_zero(amount: Column) -> Column:
    return F.coalesce(total(amount), F.lit(0.0))


def mean(amount: Column) -> Column:
    """Mean of the values present; NULL where there is none."""
    return safe_ratio(F.sum(amount), F.count(amount))


def mean_or_zero(amount: Column) -> Column:
    return F.coalesce(mean(amount), F.lit(0.0))


def mean_of_ratio(ratio: Column, digits: int = 6) -> Column:
    """Mean of doubles, rounded: their sum depends on the order of arrival."""
    return F.round(F.avg(ratio), digits)


def zero_if_null(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0))


def safe_ratio(above: Column, below: Column) -> Column:
    """Double quotient, NULL when the divisor is zero."""
    return F.try_divide(above.cast("double"), below.cast("double"))


def ratio_or_zero(above: Column, below: Column) -> Column:
    return F.coalesce(safe_ratio(above, below), F.lit(0.0))


def usage_amount(operations: Sequence[int] = USAGE_OPERATIONS) -> Column:
    """The deducted amount where the event is a usage event."""
    return F.when(F.col("operation_type_id").isin(*operations), F.col("deduct_amount"))


def ordinal(label: Column, order: Sequence[str]) -> Column:
    """Position of a label in a fixed report order."""
    return F.array_position(F.array(*[F.lit(name) for name in order]), label)
