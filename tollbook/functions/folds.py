"""Facts folded to a month and a key, in sums that add up: the same from facts and from stored partials."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.functions.calendar import month_of, month_start, shifted, trailing
from tollbook.functions.measures import rows
from tollbook.schemas import EVENT_MONTH


def customer_months(facts: DataFrame) -> DataFrame:
    """What each customer did in a month."""
    return facts.groupBy(month_start(F.col("creation_time")).alias("month"), "cust_num").agg(
        rows().alias("events"),
        F.sum("deduct_amount").alias("deducted"),
        F.count("deduct_amount").alias("deductions"),
        F.sum("charge_amount").alias("charged"),
        F.sum("current_amount_post").alias("left_over"),
        F.count("current_amount_post").alias("balances"),
    )


def offer_months(facts: DataFrame) -> DataFrame:
    """What each customer did in a month on an offer."""
    month = month_start(F.col("creation_time")).alias("month")
    return facts.groupBy(month, "offer_id", "cust_num").agg(
        rows().alias("events"), F.sum("deduct_amount").alias("deducted")
    )


FOLDS = {"customer_months": customer_months, "offer_months": offer_months}


def folded_window(tables: Mapping[str, DataFrame], name: str, as_of: datetime, months: int) -> DataFrame:
    """A fold of the facts of the last ``months`` months.

    Where ``tables`` hold it as stored partials, only the month in which the window begins, of which a part
    counts, is folded from facts.
    """
    facts = tables["cdr_events"]
    if name not in tables:
        return FOLDS[name](trailing(facts, as_of, months, "MONTH"))
    start = shifted(as_of, -months, "MONTH")
    edge = facts.filter((F.col(EVENT_MONTH) == month_of(start)) & (F.col("creation_time") >= start))
    whole = tables[name].filter(F.col(EVENT_MONTH) > month_of(start)).drop(EVENT_MONTH)
    return whole.unionByName(FOLDS[name](edge))
