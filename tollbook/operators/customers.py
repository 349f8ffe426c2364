"""Customer segments, behaviour and journeys."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollbook.functions.calendar import day_of, hours_between, trailing
from tollbook.functions.categories import PREFERENCE_RULES, CategoryRules, category
from tollbook.functions.measures import (
    mean,
    mean_of_ratio,
    ordinal,
    ratio_or_zero,
    rows,
    safe_ratio,
    total,
    total_or_zero,
)
from tollbook.functions.ranking import nearest_rank
from tollbook.sources.tables import Tables


def with_customer_type(per_customer: DataFrame, tables: Tables) -> DataFrame:
    """Attach ``cust_type``; rows of customers not in the master are left out."""
    return per_customer.join(
        tables["customers"].withColumnRenamed("cust_num_bigint", "cust_num"), "cust_num"
    )


def customer_type_distribution(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Customers and objects per type; customers without objects are counted."""
    owned = (
        tables["objects"]
        .groupBy("cust_num_bigint")
        .agg(F.count("object_id_bigint").alias("objects_owned"))
    )
    return (
        tables["customers"]
        .join(owned, "cust_num_bigint", "left")
        .groupBy("cust_type")
        .agg(
            F.count("cust_num_bigint").alias("customer_count"),
            F.coalesce(F.sum("objects_owned"), F.lit(0)).alias("object_count"),
        )
    )


# Segment labels in report order.
SPENDING_SEGMENTS = ("High Value", "Medium Value", "Low Value")


def customer_spending_segments(
    tables: Tables,
    as_of: datetime | None = None,
    high_share: Decimal = Decimal("0.8"),
    medium_share: Decimal = Decimal("0.5"),
) -> DataFrame:
    """Customers split at two exact nearest-rank percentiles of their total spending.

    The percentiles count customers with transactions, which all of these are. Saying so makes
    them ask the fold for the columns the segments ask for, so that Spark sees one shuffle
    in both and folds the facts once.
    """
    spending = with_customer_type(
        tables["cdr_events"]
        .groupBy("cust_num")
        .agg(
            F.sum("deduct_amount").alias("total_spent"),
            F.count("deduct_amount").alias("deductions"),
            rows().alias("transactions"),
        ),
        tables,
    ).withColumn("mean_transaction", safe_ratio(F.col("total_spent"), F.col("deductions")))
    has_transactions = (F.col("transactions") > 0) & (F.col("deductions") >= 0)
    limits = nearest_rank(
        spending,
        "total_spent",
        {"high": high_share, "medium": medium_share},
        counted_where=has_transactions,
    )
    high, medium, low = SPENDING_SEGMENTS
    segment = (
        F.when(F.col("total_spent") >= limits.getField("high"), high)
        .when(F.col("total_spent") >= limits.getField("medium"), medium)
        .otherwise(low)
    )
    return (
        spending.withColumn("spending_segment", segment)
        .groupBy("spending_segment", "cust_type")
        .agg(
            rows().alias("customer_count"),
            mean(F.col("total_spent")).alias("avg_total_spent"),
            mean(F.col("transactions")).alias("avg_transactions"),
            mean_of_ratio(F.col("mean_transaction")).alias("avg_transaction_size"),
        )
        .orderBy(ordinal(F.col("spending_segment"), SPENDING_SEGMENTS), "cust_type")
    )


def customer_behavior_by_type(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Usage and spending of customers with events, per customer type."""
    amounts = ("deduct_amount", "charge_amount", "current_amount_post")
    per_customer = (
        tables["cdr_events"]
        .groupBy("cust_num")
        .agg(
            rows().alias("events"),
            *[F.sum(a).alias(f"{a}_sum") for a in amounts],
            *[F.count(a).alias(f"{a}_n") for a in amounts],
        )
    )

    def pooled_mean(amount: str) -> Column:
        return ratio_or_zero(F.sum(f"{amount}_sum"), F.sum(f"{amount}_n"))

    return (
        with_customer_type(per_customer, tables)
        .groupBy("cust_type")
        .agg(
            rows().alias("active_customers"),
            pooled_mean("deduct_amount").alias("avg_deduct_amount"),
            pooled_mean("charge_amount").alias("avg_charge_amount"),
            total_or_zero(F.col("deduct_amount_sum")).alias("total_revenue"),
            F.sum("events").alias("total_events"),
            safe_ratio(F.sum("events"), rows()).alias("avg_events_per_customer"),
            pooled_mean("current_amount_post").alias("avg_balance_after_transaction"),
        )
    )


def customer_offer_preferences(
    tables: Tables, as_of: datetime | None = None, rules: CategoryRules = PREFERENCE_RULES
) -> DataFrame:
    """Customers by the kind of their most used offer, with their spending on everything.

    One pass over the facts serves both: the fold keeps events without a known offer for
    the spending, and the order puts them last. Equal use goes by offer name.
    """
    use = (
        tables["cdr_events"]
        .join(tables["offers"], "offer_id", "left")
        .groupBy("cust_num", "offer_name")
        .agg(rows().alias("uses"), F.sum("deduct_amount").alias("spent"))
    )
    customer = Window.partitionBy("cust_num")
    most_used = customer.orderBy(F.col("offer_name").isNull(), F.desc("uses"), "offer_name")
    per_customer = (
        use.withColumn("place", F.row_number().over(most_used))
        .withColumn("total_spent", F.sum("spent").over(customer))
        .filter((F.col("place") == 1) & F.col("offer_name").isNotNull())
    )
    return (
        per_customer.groupBy(category(F.col("offer_name"), rules).alias("user_segment"))
        .agg(
            rows().alias("customer_count"),
            mean(F.col("total_spent")).alias("avg_customer_value"),
        )
        .orderBy(F.desc("customer_count"), "user_segment")
    )


def customer_lifecycle(
    tables: Tables, as_of: datetime | None = None, min_transactions: int = 5
) -> DataFrame:
    """How long charged and current amounts last, per customer with enough charges."""
    created = F.col("creation_time")
    per_customer = (
        tables["cdr_events"]
        .filter(
            F.col("charge_expire_time").isNotNull()
            & F.col("current_amount_expire_time").isNotNull()
            & (F.col("charge_amount") > 0)
        )
        .groupBy("cust_num")
        .agg(
            mean(hours_between(created, F.col("charge_expire_time"))).alias(
                "avg_charge_lifetime_hours"
            ),
            mean(hours_between(created, F.col("current_amount_expire_time"))).alias(
                "avg_current_lifetime_hours"
            ),
            mean(F.col("charge_amount")).alias("avg_charge_amount"),
            mean(F.col("current_amount_post")).alias("avg_final_balance"),
            rows().alias("transaction_count"),
        )
        .filter(F.col("transaction_count") >= min_transactions)
    )
    return with_customer_type(per_customer, tables).select(
        "cust_num",
        "cust_type",
        "avg_charge_lifetime_hours",
        "avg_current_lifetime_hours",
        "avg_charge_amount",
        "avg_final_balance",
        "transaction_count",
    )


# Last day of each stage, and stage labels in report order.
JOURNEY_STAGES = (
    (7, "New Customer (0-7 days)"),
    (30, "Early Stage (8-30 days)"),
    (90, "Growing (31-90 days)"),
    (None, "Mature (90+ days)"),
)
STAGE_LABELS = tuple(label for _, label in JOURNEY_STAGES)


def _journey_stage(days: Column) -> Column:
    stage = F.lit(STAGE_LABELS[-1])
    for last_day, label in reversed(JOURNEY_STAGES[:-1]):
        stage = F.when(days <= last_day, F.lit(label)).otherwise(stage)
    return stage


def _journey(tables: Tables, as_of: datetime, months: int) -> DataFrame:
    daily = (
        trailing(tables["cdr_events"], as_of, months, "MONTH")
        .join(tables["offers"], "offer_id")
        .groupBy("cust_num", "offer_name", day_of(F.col("creation_time")).alias("day"))
        .agg(rows().alias("events"), F.sum("deduct_amount").alias("spent"))
    )
    first_day = F.min("day").over(Window.partitionBy("cust_num"))
    per_stage = (
        daily.withColumn("journey_stage", _journey_stage(F.datediff("day", first_day)))
        .groupBy("cust_num", "journey_stage")
        .agg(
            F.sum("events").alias("events"),
            F.sum("spent").alias("spent"),
            F.count_distinct("offer_name").alias("offers_tried"),
        )
    )
    return per_stage.groupBy("journey_stage").agg(
        rows().alias("customers_count"),
        mean(F.col("events")).alias("avg_transactions"),
        mean(F.col("spent")).alias("avg_spending"),
        mean(F.col("offers_tried")).alias("avg_offers_tried"),
        total(F.col("spent")).alias("total_stage_revenue"),
    )


def customer_journey(tables: Tables, as_of: datetime, months: int = 6) -> DataFrame:
    """Activity by days since a customer's first offer event in the trailing window.

    Stages depend on dates only, so the facts are folded to customer, offer and date, and
    the window that finds the first date runs over those folded rows.
    """
    in_order = ordinal(F.col("journey_stage"), STAGE_LABELS)
    return _journey(tables, as_of, months).orderBy(in_order)


def journey_funnel(tables: Tables, as_of: datetime, months: int = 6) -> DataFrame:
    """Customers of each stage as a percentage of the first stage that has any."""
    # At most four rows, one per stage, so one task may hold and order them.
    in_order = ordinal(F.col("journey_stage"), STAGE_LABELS)
    first = F.first("customers_count").over(Window.orderBy(in_order))
    return (
        _journey(tables, as_of, months)
        .select(
            "journey_stage",
            "customers_count",
            (safe_ratio(F.col("customers_count"), first) * 100).alias("pct_initial"),
        )
        .orderBy(in_order)
    )


def journey_sequence(tables: Tables, as_of: datetime, months: int = 6) -> DataFrame:
    """Every offer event of the window with its number in the customer's sequence.

    Events are numbered inside customer-minutes, and each minute is offset by the events of
    the minutes before. Only the folded minutes of a customer ever meet in one task, never
    the events. Events at the same instant go by event id, offer and amount.
    """
    events = (
        trailing(tables["cdr_events"], as_of, months, "MONTH")
        .join(tables["offers"], "offer_id")
        .select(
            "cust_num",
            "creation_time",
            "offer_name",
            "deduct_amount",
            "cdr_event_id",
            day_of(F.col("creation_time")).alias("day"),
            (F.hour("creation_time") * 60 + F.minute("creation_time")).alias("minute"),
        )
    )
    by_customer = Window.partitionBy("cust_num")
    earlier = by_customer.orderBy("day", "minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = (
        events.groupBy("cust_num", "day", "minute")
        .agg(rows().alias("n"))
        .select(
            "cust_num",
            "day",
            "minute",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            F.min("day").over(by_customer).alias("first_day"),
        )
    )
    inside_minute = Window.partitionBy("cust_num", "day", "minute").orderBy(
        "creation_time", "cdr_event_id", "offer_name", "deduct_amount"
    )
    return events.join(minutes, ["cust_num", "day", "minute"]).select(
        "cust_num",
        "creation_time",
        "offer_name",
        F.col("deduct_amount").cast("double").alias("deduct_amount"),
        (F.col("before") + F.row_number().over(inside_minute)).alias("transaction_sequence"),
        F.datediff("day", "first_day").cast("bigint").alias("days_from_first_transaction"),
    )
