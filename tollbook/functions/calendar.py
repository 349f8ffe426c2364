"""Wall-clock time relative to an explicit ``as_of``.

All times are ``timestamp_ntz``. Differences are taken on intervals, never through
``timestamp``, so no session time zone or daylight-saving rule can change a result.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollbook.schemas import EVENT_MONTH


def moment(as_of: datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def shifted(as_of: datetime, amount: int, unit: str) -> Column:
    """``as_of`` moved by ``amount`` units; month ends are clamped."""
    return moment(as_of) + F.expr(f"INTERVAL '{amount}' {unit}")


def day_start(as_of: datetime, days: int = 0) -> Column:
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return shifted(midnight, days, "DAY")


def trailing(facts: DataFrame, as_of: datetime, amount: int, unit: str) -> DataFrame:
    """Facts of the last ``amount`` units; later-dated facts stay in.

    The bound is a constant, so it reaches the file scan. On the stored table the
    month of the same bound prunes partition folders as well.
    """
    start = shifted(as_of, -amount, unit)
    kept = facts.filter(F.col("creation_time") >= start)
    if EVENT_MONTH in facts.columns:
        kept = kept.filter(F.col(EVENT_MONTH) >= month_of(start))
    return kept


def month_start(time: Column) -> Column:
    """The first day of the month: a key of four bytes for folds over many rows."""
    return F.trunc(F.to_date(time), "MM")


def month_label(day: Column) -> Column:
    """``yyyy-MM``, for folded rows."""
    return F.date_format(day, "yyyy-MM")


def month_of(time: Column) -> Column:
    return month_label(F.to_date(time))


def day_of(time: Column) -> Column:
    return F.to_date(time)


def days_between(later: Column, earlier: Column) -> Column:
    """Difference of the date parts."""
    return F.datediff(F.to_date(later), F.to_date(earlier)).cast("bigint")


def hours_between(start: Column, end: Column) -> Column:
    """Complete hours, truncated toward zero."""
    gap = end - start
    return F.extract(F.lit("DAY"), gap).cast("bigint") * 24 + F.extract(F.lit("HOUR"), gap)


def minutes_between(start: Column, end: Column) -> Column:
    """Complete minutes, truncated toward zero."""
    return hours_between(start, end) * 60 + F.extract(F.lit("MINUTE"), end - start)
