"""Operations, balance objects, time patterns, expiry and capacity."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollbook.functions.calendar import (
    day_of,
    moment,
    shifted,
    trailing,
)
from tollbook.functions.categories import (
    NETWORK_DATA_FRAGMENTS,
    NETWORK_VOICE_FRAGMENTS,
    mentions,
)
from tollbook.functions.measures import (
    mean,
    mean_of_ratio,
    mean_or_zero,
    rows,
    rows_where,
    safe_ratio,
    total,
    total_or_zero,
)
from tollbook.sources.tables import Tables


def operations_breakdown(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Events, customers and deductions of every operation type."""
    folded = (
        tables["cdr_events"]
        .groupBy("operation_type_id")
        .agg(
            rows().alias("event_count"),
            F.count_distinct("cust_num").alias("customer_count"),
            mean_or_zero(F.col("deduct_amount")).alias("avg_deduct_amount"),
            total_or_zero(F.col("deduct_amount")).alias("total_deduct_amount"),
        )
    )
    columns = ("event_count", "customer_count", "avg_deduct_amount", "total_deduct_amount")
    return (
        tables["operation_types"]
        .join(folded, "operation_type_id", "left")
        .select(
            "operation_type_id",
            "description",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in columns],
        )
        .orderBy(F.desc("event_count"), "operation_type_id")
    )


def object_types_analysis(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Objects and their customers per object type; object ids are unique in the table."""
    folded = (
        tables["objects"]
        .groupBy("object_type_id")
        .agg(
            F.count("object_id_bigint").alias("object_count"),
            F.count_distinct("cust_num_bigint").alias("customer_count"),
        )
    )
    return (
        tables["object_types"]
        .join(folded, "object_type_id", "left")
        .select(
            "object_type_code",
            "description",
            F.coalesce("object_count", F.lit(0)).alias("object_count"),
            F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
        )
        .orderBy(F.desc("object_count"), "object_type_code")
    )


def daily_series(tables: Tables, as_of: datetime, years: int = 5) -> DataFrame:
    return (
        trailing(tables["cdr_events"], as_of, years, "YEAR")
        .groupBy(day_of(F.col("creation_time")).alias("event_date"))
        .agg(
            rows().alias("event_count"),
            total_or_zero(F.col("deduct_amount")).alias("total_deduct_amount"),
            F.count_distinct("cust_num").alias("active_customers"),
        )
        .orderBy("event_date")
    )


# Day names from day 1 on, and the heatmap's columns.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _by_hour_and_weekday(tables: Tables, as_of: datetime, months: int) -> DataFrame:
    created = F.col("creation_time")
    return trailing(tables["cdr_events"], as_of, months, "MONTH").select(
        F.hour(created).cast("bigint").alias("hour_of_day"),
        F.dayofweek(F.to_date(created)).cast("bigint").alias("day_num"),
        "deduct_amount",
        "cust_num",
    )


def usage_patterns(tables: Tables, as_of: datetime, months: int = 3) -> DataFrame:
    """Events, revenue and customers per hour of the day and day of the week."""
    names = F.array(*[F.lit(day) for day in WEEKDAYS])
    return (
        _by_hour_and_weekday(tables, as_of, months)
        .groupBy("hour_of_day", "day_num")
        .agg(
            rows().alias("event_count"),
            total(F.col("deduct_amount")).alias("total_revenue"),
            F.count_distinct("cust_num").alias("active_customers"),
            mean(F.col("deduct_amount")).alias("avg_transaction_amount"),
        )
        .withColumn("day_of_week", F.element_at(names, F.col("day_num").cast("int")))
        .orderBy("day_num", "hour_of_day")
    )


def usage_heatmap(tables: Tables, as_of: datetime, months: int = 3) -> DataFrame:
    """Event counts with one row per hour and one column per weekday."""
    numbers = list(range(1, len(WEEKDAYS) + 1))
    counts = (
        _by_hour_and_weekday(tables, as_of, months)
        .groupBy("hour_of_day")
        .pivot("day_num", numbers)
        .agg(rows())
        .na.fill(0)
    )
    return counts.toDF("hour_of_day", *WEEKDAYS).orderBy("hour_of_day")


def expiry_forecast(
    tables: Tables, as_of: datetime, years: int = 1, grain: str = "raw"
) -> DataFrame:
    """Objects that have expired or will within the horizon, by expiry and object type.

    ``grain='raw'`` keeps one line per expiry instant, shown with its date; ``grain='day'``
    adds up the instants of a day.
    """
    instant = {"raw": F.col("expiry_date"), "day": day_of(F.col("expiry_date"))}[grain]
    expiring = (
        tables["objects"]
        .filter(F.col("expiry_date") <= shifted(as_of, years, "YEAR"))
        .join(tables["object_types"], "object_type_id")
        .groupBy(instant.alias("instant"), F.col("description").alias("object_type"))
        .agg(
            F.count("object_id_bigint").alias("expiring_objects"),
            F.count_distinct("cust_num_bigint").alias("affected_customers"),
        )
    )
    return expiring.select(
        day_of(F.col("instant")).alias("expiry_date"),
        "object_type",
        "expiring_objects",
        "affected_customers",
    ).orderBy("expiry_date", "object_type")


# Status labels.
EXPIRED, NOT_EXPIRED = "Has Expired Balances", "No Expired Balances"


def expiry_impact(tables: Tables, as_of: datetime) -> DataFrame:
    """Customers with and without expired balances, and what has expired."""
    now = moment(as_of)

    def expired(until: str, amount: str) -> Column:
        gone = (F.col(until) < now) & (F.col(amount) > 0)
        return F.sum(F.when(gone, F.col(amount)).otherwise(F.lit(0).cast("decimal(15,2)")))

    per_customer = (
        tables["cdr_events"]
        .filter(
            F.col("charge_expire_time").isNotNull()
            | F.col("current_amount_expire_time").isNotNull()
        )
        .groupBy("cust_num")
        .agg(
            expired("charge_expire_time", "charge_amount").alias("expired_charged"),
            expired("current_amount_expire_time", "current_amount_post").alias("expired_current"),
            F.sum("charge_amount").alias("charged"),
        )
    )
    has_expired = (F.col("expired_charged") > 0) | (F.col("expired_current") > 0)
    return per_customer.groupBy(
        F.when(has_expired, EXPIRED).otherwise(NOT_EXPIRED).alias("expiry_status")
    ).agg(
        rows().alias("customer_count"),
        mean(F.col("expired_charged")).alias("avg_expired_charged"),
        mean(F.col("expired_current")).alias("avg_expired_current"),
        total(F.col("expired_charged") + F.col("expired_current")).alias("total_expired_value"),
        mean(F.col("charged")).alias("avg_total_charged"),
        mean_of_ratio(safe_ratio(F.col("expired_charged"), F.col("charged"))).alias("expiry_rate"),
    )


# Status labels.
PEAK_HOURS, LOW_USAGE, NORMAL_USAGE = "Peak Hours", "Low Usage", "Normal Usage"


def network_capacity(
    tables: Tables,
    as_of: datetime,
    days: int = 7,
    peak_factor: float = 1.2,
    low_factor: float = 0.8,
    data_fragments: Sequence[str] = NETWORK_DATA_FRAGMENTS,
    voice_fragments: Sequence[str] = NETWORK_VOICE_FRAGMENTS,
) -> DataFrame:
    """Mean, peak and least load per hour of the day over the last days."""
    catalogue = tables["offers"].select(
        "offer_id",
        mentions(F.col("offer_name"), data_fragments).alias("is_data"),
        mentions(F.col("offer_name"), voice_fragments).alias("is_voice"),
    )
    created = F.col("creation_time")
    hourly = (
        trailing(tables["cdr_events"], as_of, days, "DAY")
        .join(catalogue, "offer_id", "left")
        .groupBy(day_of(created).alias("day"), F.hour(created).cast("bigint").alias("usage_hour"))
        .agg(
            rows().alias("events"),
            F.count_distinct("cust_num").alias("users"),
            rows_where(F.col("is_data")).alias("data_events"),
            rows_where(F.col("is_voice")).alias("voice_events"),
        )
    )
    per_hour = hourly.groupBy("usage_hour").agg(
        mean(F.col("events")).alias("avg_events_per_hour"),
        mean(F.col("users")).alias("avg_users_per_hour"),
        mean(F.col("data_events")).alias("avg_data_events"),
        mean(F.col("voice_events")).alias("avg_voice_events"),
        F.max("events").alias("peak_events"),
        F.min("events").alias("min_events"),
    )
    # One row per hour of the day, 24 at most, so one task may hold them all.
    level = F.avg("avg_events_per_hour").over(Window.partitionBy())
    status = (
        F.when(F.col("avg_events_per_hour") > level * peak_factor, PEAK_HOURS)
        .when(F.col("avg_events_per_hour") < level * low_factor, LOW_USAGE)
        .otherwise(NORMAL_USAGE)
    )
    return per_hour.withColumn("capacity_status", status).orderBy("usage_hour")
