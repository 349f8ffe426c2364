"""Current activity, freshness and health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.functions.calendar import day_start, minutes_between, moment, shifted, trailing
from tollbook.functions.measures import rows, safe_ratio, zero_if_null
from tollbook.schemas import literal_rows
from tollbook.sources.tables import Tables

# Line labels and the status texts.
SNAPSHOT_LINES = ("current_hour", "today", "yesterday")
HEALTHY = "Healthy"
STALE = "Warning - Data not fresh (last record over 60 mins ago)"


def activity_snapshot(tables: Tables, as_of: datetime) -> DataFrame:
    """Activity of the last hour, today and yesterday: always three lines.

    One reading from the start of yesterday on serves all three. The last hour is open
    toward the future, the days are not.
    """
    spark = tables["cdr_events"].sparkSession
    created = F.col("creation_time")
    yesterday, today, tomorrow = (day_start(as_of, days) for days in (-1, 0, 1))
    spans = F.array_compact(
        F.array(
            F.when(created >= shifted(as_of, -1, "HOUR"), F.lit(SNAPSHOT_LINES[0])),
            F.when((created >= today) & (created < tomorrow), F.lit(SNAPSHOT_LINES[1])),
            F.when((created >= yesterday) & (created < today), F.lit(SNAPSHOT_LINES[2])),
        )
    )
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    measured = (
        trailing(tables["cdr_events"], midnight, 1, "DAY")
        .select(
            F.explode(spans).alias("metric_type"),
            "cust_num",
            zero_if_null(F.col("deduct_amount")).alias("deducted"),
        )
        .groupBy("metric_type")
        .agg(
            rows().alias("events"),
            F.count_distinct("cust_num").alias("users"),
            F.sum("deducted").alias("revenue"),
        )
    )
    line = T.StructType([T.StructField("metric_type", T.StringType())])
    lines = literal_rows(spark, [(name,) for name in SNAPSHOT_LINES], line)
    return lines.join(measured, "metric_type", "left").select(
        "metric_type",
        F.coalesce("events", F.lit(0)).alias("event_count"),
        F.coalesce("users", F.lit(0)).alias("active_users"),
        F.col("revenue").cast("double").alias("total_revenue"),
        safe_ratio(F.col("revenue"), F.col("events")).alias("avg_transaction_value"),
    )


def system_health(tables: Tables, as_of: datetime) -> DataFrame:
    """Freshness of the facts, and the activity of the last hour."""
    latest = F.max("creation_time")
    freshness = tables["cdr_events"].agg(
        latest.alias("latest_record"),
        minutes_between(latest, moment(as_of)).alias("minutes_since_last_record"),
        rows().alias("total_records"),
        F.count_distinct("cust_num").alias("total_customers"),
    )
    recent = trailing(tables["cdr_events"], as_of, 1, "HOUR").agg(
        moment(as_of).alias("latest_record"),
        F.lit(0).cast("bigint").alias("minutes_since_last_record"),
        rows().alias("total_records"),
        F.count_distinct("cust_num").alias("total_customers"),
    )
    return freshness.select(F.lit("data_freshness").alias("health_metric"), "*").unionByName(
        recent.select(F.lit("recent_activity").alias("health_metric"), "*")
    )


def health_status(tables: Tables, as_of: datetime, fresh_minutes: int = 60) -> DataFrame:
    latest = F.max("creation_time")
    age = tables["cdr_events"].agg(minutes_between(latest, moment(as_of)).alias("age"))
    return age.select(
        F.when(F.col("age") > fresh_minutes, STALE).otherwise(HEALTHY).alias("health_status")
    )
