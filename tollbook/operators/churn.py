"""Churn, churn risk and seasons."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollbook.functions.calendar import day_of, days_between, moment, trailing
from tollbook.functions.measures import mean, ordinal, rows, total
from tollbook.operators.customers import with_customer_type
from tollbook.sources.tables import Tables


def churn_by_quarter(tables: Tables, as_of: datetime, inactive_days: int = 90) -> DataFrame:
    """Master customers gone quiet, by the quarter of their last event.

    A customer without events has no last event and belongs to no quarter.
    """
    last = tables["cdr_events"].groupBy("cust_num").agg(F.max("creation_time").alias("last_event"))
    gone = with_customer_type(last, tables).filter(
        days_between(moment(as_of), F.col("last_event")) > inactive_days
    )
    period = F.concat(
        F.year("last_event").cast("string"), F.lit("-Q"), F.quarter("last_event").cast("string")
    )
    return gone.groupBy(period.alias("period")).agg(rows().alias("churn_count")).orderBy("period")


def churn_by_offer(tables: Tables, as_of: datetime, inactive_days: int = 90) -> DataFrame:
    """Customers who stopped using an offer, whether or not they use others."""
    lapsed = (
        tables["cdr_events"]
        .groupBy("offer_id", "cust_num")
        .agg(F.max("creation_time").alias("last_use"))
        .filter(days_between(moment(as_of), F.col("last_use")) > inactive_days)
        .groupBy("offer_id")
        .agg(F.count("cust_num").alias("churned_customers"))
    )
    return (
        tables["offers"]
        .join(lapsed, "offer_id")
        .select("offer_id", "offer_name", "churned_customers")
        .orderBy(F.desc("churned_customers"), "offer_id")
    )


# Risk labels in report order.
RISK_LEVELS = ("High Risk", "Medium Risk", "Low Engagement", "Active")


def _activity(
    tables: Tables,
    as_of: datetime,
    high_days: int,
    medium_days: int,
    engaged_transactions: int,
    flag_transactions: int,
) -> DataFrame:
    """One line per customer, folded by way of customer-days to count the active days."""
    idle = F.col("days_since_last_activity")
    count = F.col("total_transactions")
    high, medium, low, active = RISK_LEVELS
    level = (
        F.when(idle > high_days, high)
        .when(idle > medium_days, medium)
        .when(count < engaged_transactions, low)
        .otherwise(active)
    )
    flag = F.when((idle > high_days) | (count < flag_transactions), 1).otherwise(0)
    per_day = (
        tables["cdr_events"]
        .groupBy("cust_num", day_of(F.col("creation_time")).alias("day"))
        .agg(
            rows().alias("events"),
            F.sum("deduct_amount").alias("spent"),
            F.count("deduct_amount").alias("spent_n"),
            F.max("creation_time").alias("latest"),
        )
    )
    folded = per_day.groupBy("cust_num").agg(
        F.sum("events").alias("total_transactions"),
        F.sum("spent").alias("spent"),
        F.sum("spent_n").alias("spent_n"),
        F.max("latest").alias("last_activity"),
        F.count("day").alias("active_days"),
    )
    return (
        with_customer_type(folded, tables)
        .withColumn(
            "days_since_last_activity", days_between(moment(as_of), F.col("last_activity"))
        )
        .withColumn("churn_risk_level", level)
        .withColumn("churn_flag", flag)
    )


def customer_churn_flags(
    tables: Tables,
    as_of: datetime,
    high_days: int = 30,
    medium_days: int = 14,
    engaged_transactions: int = 5,
    flag_transactions: int = 3,
) -> DataFrame:
    activity = _activity(
        tables, as_of, high_days, medium_days, engaged_transactions, flag_transactions
    )
    return activity.select(
        "cust_num",
        "cust_type",
        "total_transactions",
        F.col("spent").cast("double").alias("total_spent"),
        "last_activity",
        "days_since_last_activity",
        F.try_divide(F.col("spent").cast("double"), F.col("spent_n").cast("double")).alias(
            "avg_transaction_amount"
        ),
        "active_days",
        "churn_risk_level",
        "churn_flag",
    )


def churn_risk(
    tables: Tables,
    as_of: datetime,
    high_days: int = 30,
    medium_days: int = 14,
    engaged_transactions: int = 5,
) -> DataFrame:
    """Customers and revenue per risk level and customer type."""
    return (
        _activity(tables, as_of, high_days, medium_days, engaged_transactions, 0)
        .groupBy("churn_risk_level", "cust_type")
        .agg(
            rows().alias("customer_count"),
            mean(F.col("spent")).alias("avg_spent"),
            mean(F.col("days_since_last_activity")).alias("avg_days_inactive"),
            mean(F.col("total_transactions")).alias("avg_transactions"),
            total(F.col("spent")).alias("total_revenue_at_risk"),
        )
        .orderBy(ordinal(F.col("churn_risk_level"), RISK_LEVELS), "cust_type")
    )


# Season labels.
PEAK_SEASON, LOW_SEASON, NORMAL_SEASON = "Peak Season", "Low Season", "Normal Season"


def seasonality(
    tables: Tables,
    as_of: datetime,
    months: int = 24,
    peak_factor: float = 1.1,
    low_factor: float = 0.9,
) -> DataFrame:
    """Calendar months compared over the years, each classed by its mean revenue."""
    day = F.to_date("creation_time")
    monthly = (
        trailing(tables["cdr_events"], as_of, months, "MONTH")
        .groupBy(F.year(day).alias("year"), F.month(day).cast("bigint").alias("month"))
        .agg(
            F.date_format(F.min(day), "MMMM").alias("month_name"),
            rows().alias("events"),
            F.sum("deduct_amount").alias("revenue"),
            F.count_distinct("cust_num").alias("customers"),
        )
    )
    seasons = monthly.groupBy("month", "month_name").agg(
        mean(F.col("events")).alias("avg_monthly_events"),
        mean(F.col("revenue")).alias("avg_monthly_revenue"),
        mean(F.col("customers")).alias("avg_monthly_customers"),
        F.round(F.stddev_pop(F.col("revenue").cast("double")), 4).alias("revenue_volatility"),
        rows().alias("data_points"),
    )
    # One row per calendar month, twelve at most, so one task may hold them all.
    level = F.avg("avg_monthly_revenue").over(Window.partitionBy())
    season = (
        F.when(F.col("avg_monthly_revenue") > level * peak_factor, PEAK_SEASON)
        .when(F.col("avg_monthly_revenue") < level * low_factor, LOW_SEASON)
        .otherwise(NORMAL_SEASON)
    )
    return (
        seasons.withColumn("season_type", season)
        .select(
            "month",
            "month_name",
            "avg_monthly_events",
            "avg_monthly_revenue",
            "avg_monthly_customers",
            "revenue_volatility",
            "season_type",
            "data_points",
        )
        .orderBy("month")
    )
