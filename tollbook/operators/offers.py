"""Offer use, trends, cross-selling, competition and recommendation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollbook.functions.calendar import (
    day_of,
    days_between,
    hours_between,
    moment,
    month_label,
    month_start,
    trailing,
)
from tollbook.functions.categories import (
    BUNDLE_FRAGMENTS,
    PRODUCT_RULES,
    RECOMMENDATION_CANDIDATES,
    RECOMMENDATION_RULES,
    CategoryRules,
    category,
    mentions,
)
from tollbook.functions.folds import folded_window
from tollbook.functions.measures import (
    mean,
    mean_or_zero,
    ratio_or_zero,
    rows,
    safe_ratio,
    total,
    total_or_zero,
    zero_if_null,
)
from tollbook.sources.tables import Tables


def _every_offer(offers: DataFrame, folded: DataFrame, zeros: Sequence[str]) -> DataFrame:
    """Catalogue rows beside their folded facts; offers without facts show zeros."""
    return offers.join(folded, "offer_id", "left").select(
        "offer_id", "offer_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in zeros]
    )


def _by_subscribers(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("subscriber_count"), "offer_id")


def offers_summary(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Subscribers, events and deductions of every offer."""
    folded = (
        tables["cdr_events"]
        .groupBy("offer_id")
        .agg(
            F.count_distinct("cust_num").alias("subscriber_count"),
            rows().alias("event_count"),
            mean_or_zero(F.col("deduct_amount")).alias("avg_deduct_amount"),
            total_or_zero(F.col("deduct_amount")).alias("total_deduct_amount"),
        )
    )
    columns = ("subscriber_count", "event_count", "avg_deduct_amount", "total_deduct_amount")
    return _by_subscribers(_every_offer(tables["offers"], folded, columns))


def offer_performance(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """The same with the mean days since a customer's first event on the offer.

    The mean needs no look back at single events: per customer and offer, the days since
    the first one add up to the sum of the day numbers less the first day for each event.
    """
    day_number = F.unix_date(day_of(F.col("creation_time"))).cast("bigint")
    per_customer = (
        tables["cdr_events"]
        .groupBy("offer_id", "cust_num")
        .agg(
            rows().alias("events"),
            F.sum("deduct_amount").alias("used"),
            F.sum(day_number).alias("day_numbers"),
            F.min(day_number).alias("first_day"),
        )
    )
    lifetime = F.sum(F.col("day_numbers") - F.col("events") * F.col("first_day"))
    folded = per_customer.groupBy("offer_id").agg(
        F.count("cust_num").alias("subscriber_count"),
        F.sum("events").alias("event_count"),
        total_or_zero(F.col("used")).alias("total_usage"),
        ratio_or_zero(lifetime, F.sum("events")).alias("avg_offer_lifetime_days"),
    )
    columns = ("subscriber_count", "event_count", "total_usage", "avg_offer_lifetime_days")
    return _by_subscribers(_every_offer(tables["offers"], folded, columns))


def _monthly_offers(tables: Tables, as_of: datetime, months: int) -> DataFrame:
    return (
        folded_window(tables, "offer_months", as_of, months)
        .join(tables["offers"], "offer_id")
        .groupBy("month", "offer_name")
        .agg(
            F.count_distinct("cust_num").alias("unique_subscribers"),
            F.sum("events").alias("total_subscriptions"),
            total(F.col("deducted")).alias("monthly_revenue"),
        )
        .withColumn("month", month_label(F.col("month")))
    )


def offer_trend(tables: Tables, as_of: datetime, months: int = 12) -> DataFrame:
    return _monthly_offers(tables, as_of, months).orderBy("month", "offer_name")


def offer_trend_top10(
    tables: Tables, as_of: datetime, months: int = 12, limit: int = 10
) -> DataFrame:
    """The trend of the offers with most monthly subscribers summed up.

    Each offer carries its few monthly lines through the choice, so the facts are read once.
    """
    lines = ("month", "unique_subscribers", "total_subscriptions", "monthly_revenue")
    leading = (
        _monthly_offers(tables, as_of, months)
        .groupBy("offer_name")
        .agg(
            F.sum("unique_subscribers").alias("subscribers"),
            F.collect_list(F.struct(*lines)).alias("lines"),
        )
        .orderBy(F.desc("subscribers"), "offer_name")
        .limit(limit)
    )
    return (
        leading.select("offer_name", F.inline("lines"))
        .select("month", "offer_name", *lines[1:])
        .orderBy("month", "offer_name")
    )


def data_bundles(
    tables: Tables,
    as_of: datetime | None = None,
    fragments: Sequence[str] = BUNDLE_FRAGMENTS,
) -> DataFrame:
    """Subscribers, use and duration of data bundles; other offers' facts drop out early."""
    bundles = tables["offers"].filter(mentions(F.col("offer_name"), fragments))
    duration = hours_between(F.col("creation_time"), F.col("charge_expire_time"))
    folded = (
        tables["cdr_events"]
        .join(bundles, "offer_id", "left_semi")
        .groupBy("offer_id")
        .agg(
            F.count_distinct("cust_num").alias("subscriber_count"),
            mean_or_zero(F.col("deduct_amount")).alias("avg_usage"),
            mean_or_zero(duration).alias("avg_duration_hours"),
        )
    )
    columns = ("subscriber_count", "avg_usage", "avg_duration_hours")
    return _by_subscribers(_every_offer(bundles, folded, columns))


def _customer_offers(tables: Tables, as_of: datetime, months: int) -> DataFrame:
    return (
        trailing(tables["cdr_events"], as_of, months, "MONTH")
        .join(tables["offers"], "offer_id")
        .groupBy("cust_num", "offer_id", "offer_name")
        .agg(rows().alias("events"), F.sum("deduct_amount").alias("spent"))
    )


def cross_offer(tables: Tables, as_of: datetime, months: int = 6) -> DataFrame:
    """How many customers use one, two, three ... offers, and what they spend."""
    per_customer = (
        _customer_offers(tables, as_of, months)
        .groupBy("cust_num")
        .agg(
            F.count_distinct("offer_id").alias("unique_offers_used"),
            F.sum("spent").alias("spent"),
            F.sum("events").alias("events"),
        )
    )
    return (
        per_customer.groupBy("unique_offers_used")
        .agg(
            rows().alias("customer_count"),
            mean(F.col("spent")).alias("avg_spending_per_customer"),
            mean(F.col("events")).alias("avg_events_per_customer"),
            total(F.col("spent")).alias("total_segment_revenue"),
        )
        .orderBy("unique_offers_used")
    )


def customer_offer_list(tables: Tables, as_of: datetime, months: int = 6) -> DataFrame:
    """The offers each customer uses, by name; a list is no longer than the catalogue."""
    return (
        _customer_offers(tables, as_of, months)
        .groupBy("cust_num")
        .agg(
            F.count_distinct("offer_id").alias("unique_offers_used"),
            F.array_join(F.array_sort(F.collect_set("offer_name")), ", ").alias("offers_used"),
            total(F.col("spent")).alias("total_spent"),
            F.sum("events").alias("total_events"),
        )
    )


def competitive(
    tables: Tables, as_of: datetime, rules: CategoryRules = PRODUCT_RULES
) -> DataFrame:
    """Offers ranked by revenue and by users inside their product category."""
    deducted = zero_if_null(F.col("deduct_amount"))
    per_offer = (
        tables["cdr_events"]
        .join(tables["offers"], "offer_id")
        .groupBy("offer_name")
        .agg(
            F.count_distinct("cust_num").alias("unique_users"),
            F.sum(deducted).alias("revenue"),
            mean(deducted).alias("avg_revenue_per_use"),
            F.min("creation_time").alias("first_used"),
        )
        .withColumn("product_category", category(F.col("offer_name"), rules))
        .withColumn("days", days_between(moment(as_of), F.col("first_used")))
    )
    inside = Window.partitionBy("product_category")
    return per_offer.select(
        "product_category",
        "offer_name",
        "unique_users",
        F.col("revenue").cast("double").alias("total_revenue"),
        "avg_revenue_per_use",
        safe_ratio(F.col("revenue"), F.col("days")).alias("daily_revenue"),
        safe_ratio(F.col("unique_users"), F.col("days")).alias("daily_user_acquisition"),
        F.rank().over(inside.orderBy(F.desc("revenue"))).cast("bigint").alias("revenue_rank"),
        F.rank().over(inside.orderBy(F.desc("unique_users"))).cast("bigint").alias("user_rank"),
    ).orderBy("product_category", F.desc("total_revenue"), "offer_name")


def next_offer(
    tables: Tables,
    as_of: datetime | None = None,
    limit: int = 3,
    rules: CategoryRules = RECOMMENDATION_RULES,
    candidates: Mapping[str, Sequence[str]] = RECOMMENDATION_CANDIDATES,
) -> DataFrame:
    """Per segment, the offers that earn most from its customers besides their main ones.

    A customer belongs to the segment of each offer they use most, once per tied offer, and
    their use of an offer counts once for every tied main offer of the segment other than
    itself. That count is known per customer and segment, so every folded (customer, offer)
    row is weighted with it and no pairs of offers are formed.
    """
    catalogue = tables["offers"].select(
        "offer_id", "offer_name", category(F.col("offer_name"), rules).alias("own_segment")
    )
    use = (
        tables["cdr_events"]
        .join(catalogue, "offer_id")
        .groupBy("cust_num", "offer_name", "own_segment")
        .agg(
            rows().alias("uses"),
            F.sum("deduct_amount").alias("spent"),
            F.count("deduct_amount").alias("spent_n"),
        )
    )
    customer = Window.partitionBy("cust_num")
    ranked = use.withColumn("is_main", F.col("uses") == F.max("uses").over(customer))

    def weight(segment: str) -> Column:
        main_here = F.when(F.col("is_main") & (F.col("own_segment") == segment), 1).otherwise(0)
        return F.sum(main_here).over(customer) - main_here

    def may_be_offered(segment: str) -> Column:
        if segment not in candidates:
            return F.lit(True)
        return mentions(F.col("offer_name"), candidates[segment])

    shares = F.array(
        *[
            F.struct(
                F.lit(segment).alias("user_segment"),
                F.when(may_be_offered(segment), weight(segment)).otherwise(0).alias("times"),
            )
            for segment in rules.labels
        ]
    )
    weighted = (
        ranked.withColumn("shares", shares)
        .select("offer_name", "spent", "spent_n", F.inline("shares"))
        .filter(F.col("times") > 0)
    )
    earned = weighted.groupBy("user_segment", "offer_name").agg(
        rows().alias("users_count"),
        F.sum(F.col("times").cast("decimal(10,0)") * F.col("spent")).alias("revenue"),
        F.sum(F.col("times") * F.col("spent_n")).alias("revenue_n"),
    )
    best = Window.partitionBy("user_segment").orderBy(F.desc("revenue"), "offer_name")
    return (
        earned.withColumn("recommendation_rank", F.row_number().over(best).cast("bigint"))
        .filter(F.col("recommendation_rank") <= limit)
        .select(
            "user_segment",
            F.col("offer_name").alias("recommended_offer"),
            "users_count",
            safe_ratio(F.col("revenue"), F.col("revenue_n")).alias("avg_revenue_per_use"),
            F.col("revenue").cast("double").alias("total_revenue"),
            "recommendation_rank",
        )
        .orderBy("user_segment", "recommendation_rank")
    )
