"""Headline figures over the whole store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollbook.functions.calendar import trailing
from tollbook.functions.measures import (
    ratio_or_zero,
    rows,
    total_or_zero,
    usage_amount,
)
from tollbook.sources.tables import Tables


def _active(tables: Tables, as_of: datetime, years: int) -> Column:
    """Customers with an event in the last years, read from those years' facts alone."""
    recent = trailing(tables["cdr_events"], as_of, years, "YEAR")
    return recent.agg(F.count_distinct("cust_num")).scalar()


def _size(table: DataFrame) -> Column:
    return table.agg(rows()).scalar()


def dashboard_kpis(tables: Tables, as_of: datetime, active_years: int = 1) -> DataFrame:
    """Figures of the opening page: all deductions are revenue, sums cut to whole units."""
    whole = lambda amount: F.coalesce(F.sum(amount).cast("bigint"), F.lit(0))
    sums = tables["cdr_events"].agg(
        whole(F.col("deduct_amount")).alias("total_revenue"),
        whole(F.col("charge_amount")).alias("total_charges"),
        rows().alias("number_of_operations"),
    )
    return sums.select(
        "total_revenue",
        "total_charges",
        F.col("total_revenue").alias("total_deducted"),
        "number_of_operations",
        _active(tables, as_of, active_years).alias("active_customers"),
        ratio_or_zero(F.col("total_revenue"), _size(tables["customers"])).alias("arpu"),
    )


def kpi_summary(tables: Tables, as_of: datetime, active_years: int = 1) -> DataFrame:
    """The same card with usage revenue only; ARPU is over all customers."""
    sums = tables["cdr_events"].agg(
        total_or_zero(usage_amount()).alias("total_revenue"),
        total_or_zero(F.col("charge_amount")).alias("total_charges"),
        rows().alias("number_of_operations"),
    )
    return sums.select(
        "total_revenue",
        "total_charges",
        F.col("total_revenue").alias("total_deducted"),
        "number_of_operations",
        _active(tables, as_of, active_years).alias("active_customers"),
        ratio_or_zero(F.col("total_revenue"), _size(tables["customers"])).alias("arpu"),
    )


def top_offer(tables: Tables, as_of: datetime | None = None, limit: int = 1) -> DataFrame:
    """The offer name with most distinct customers; equal counts go by name."""
    return (
        tables["cdr_events"]
        .join(tables["offers"], "offer_id")
        .groupBy("offer_name")
        .agg(F.count_distinct("cust_num").alias("subscriber_count"))
        .orderBy(F.desc("subscriber_count"), "offer_name")
        .limit(limit)
    )


def top_operation(tables: Tables, as_of: datetime | None = None, limit: int = 1) -> DataFrame:
    """The operation description with most events; equal counts go by description."""
    per_operation = tables["cdr_events"].groupBy("operation_type_id").agg(rows().alias("n"))
    return (
        per_operation.join(tables["operation_types"], "operation_type_id")
        .groupBy("description")
        .agg(F.sum("n").alias("event_count"))
        .orderBy(F.desc("event_count"), "description")
        .limit(limit)
    )


def object_types_used(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    return (
        tables["objects"]
        .select("object_type_id")
        .join(tables["object_types"], "object_type_id", "left_semi")
        .agg(F.count_distinct("object_type_id").alias("unique_object_types_used"))
    )


def overall_stats(tables: Tables, as_of: datetime, active_years: int = 1) -> DataFrame:
    """Thirteen statistics in one row; the two leaders are flattened to two columns each.

    Offers and operations are few, so the facts are folded to them before the distinct
    counts, which then expand the folded rows and not the facts.
    """
    folded = (
        tables["cdr_events"]
        .groupBy("offer_id", "operation_type_id")
        .agg(
            rows().alias("events"),
            F.sum(usage_amount()).alias("revenue"),
            F.sum("charge_amount").alias("charges"),
        )
    )
    sums = folded.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_cdr_events"),
        total_or_zero(F.col("revenue")).alias("total_revenue"),
        total_or_zero(F.col("charges")).alias("total_charges"),
        F.count_distinct("offer_id").alias("unique_active_offers"),
        F.count_distinct("operation_type_id").alias("unique_operation_types"),
    )
    leader = lambda frame: frame.select(F.struct(*frame.columns)).scalar()
    complete = sums.select(
        "*",
        _active(tables, as_of, active_years).alias("active_customers_year"),
        _size(tables["customers"]).alias("total_customers"),
        _size(tables["offers"]).alias("total_offers"),
        object_types_used(tables).scalar().alias("unique_object_types_used"),
        leader(top_offer(tables)).alias("offer"),
        leader(top_operation(tables)).alias("operation"),
    )
    return complete.select(
        "total_customers",
        "total_cdr_events",
        "total_revenue",
        "total_charges",
        "active_customers_year",
        "total_offers",
        ratio_or_zero(F.col("total_revenue"), F.col("total_customers")).alias(
            "avg_revenue_per_customer"
        ),
        ratio_or_zero(F.col("total_cdr_events"), F.col("total_customers")).alias(
            "avg_events_per_customer"
        ),
        "unique_active_offers",
        "unique_operation_types",
        "unique_object_types_used",
        F.coalesce("offer.offer_name", F.lit("N/A")).alias("most_popular_offer"),
        F.coalesce("offer.subscriber_count", F.lit(0)).alias("most_popular_offer_subscribers"),
        F.coalesce("operation.description", F.lit("N/A")).alias("most_popular_operation"),
        F.coalesce("operation.event_count", F.lit(0)).alias("most_popular_operation_events"),
    )


# The sentences of the report. %s takes a count or a name, %.2f a decimal.
CUSTOMERS_SERVED = "The platform currently serves a total of %s unique subscribers."
CUSTOMERS_ACTIVE = (
    "Approximately %.2f%% of your customer base (%s customers) has shown activity in the last "
    "year, indicating a core active user segment."
)
CUSTOMERS_INACTIVE = (
    "No customer activity recorded in the last year, suggesting a need for re-engagement "
    "strategies or data review."
)
REVENUE_EACH = (
    "The average revenue generated per customer from usage operations is %.2f, highlighting the "
    "value of each active user."
)
EVENTS_EACH = (
    "On average, each customer generates %.2f CDR events, providing insight into overall "
    "engagement levels."
)
EVENTS_PROCESSED = (
    "A substantial volume of %s CDR events have been processed across all operations."
)
REVENUE_TOTAL = (
    "Total revenue from usage operations stands at %.2f, which is a key performance indicator for "
    "service monetization."
)
REVENUE_NONE = (
    "While events are recorded, no revenue has been generated from usage operations, suggesting a "
    "potential issue with monetization models or data categorization."
)
EVENTS_NONE = (
    "No CDR events recorded in the system, which severely limits the ability to perform usage and "
    "revenue analysis. Data ingestion should be verified."
)
OFFERS_AVAILABLE = "There are %s distinct offers available in the system."
OFFERS_ACTIVE = (
    "Out of these, %s (%.2f%%) offers have recorded actual customer activity, indicating which "
    "offers are gaining traction."
)
OFFERS_INACTIVE = (
    "Despite having offers, none have recorded customer activity, suggesting a need to promote "
    "existing offers or introduce more appealing options."
)
OFFER_LEADING = (
    "The most popular offer, '%s', has attracted %s unique subscribers. This offer could be a model "
    "for future product development."
)
OPERATION_LEADING = (
    "The most frequent operation type is '%s' with %s events. This highlights a primary area of "
    "customer interaction."
)
OPERATIONS_USED = "A total of %s different operation types are being utilized by customers."
OBJECT_TYPES_IN_USE = (
    "Customers are actively using %s different types of balance objects, indicating diverse "
    "service consumption."
)
OBJECT_TYPES_NONE = (
    "No object types are currently in use by customers, which might impact service delivery or "
    "customer experience related to balances."
)


def overall_conclusions(tables: Tables, as_of: datetime, active_years: int = 1) -> DataFrame:
    """Sentences the statistics support, numbered from 1."""
    c = F.col
    has_customers = c("total_customers") > 0
    has_events = c("total_cdr_events") > 0
    has_offers = c("total_offers") > 0

    def sentence(condition: Column, text: str, *values: Column) -> Column:
        return F.when(condition, F.format_string(text, *values))

    def percent(part: str, whole: str) -> Column:
        return ratio_or_zero(c(part), c(whole)) * 100

    sentences = [
        sentence(has_customers, CUSTOMERS_SERVED, c("total_customers")),
        sentence(
            has_customers & (c("active_customers_year") > 0),
            CUSTOMERS_ACTIVE,
            percent("active_customers_year", "total_customers"),
            c("active_customers_year"),
        ),
        sentence(has_customers & (c("active_customers_year") == 0), CUSTOMERS_INACTIVE),
        sentence(
            has_customers & (c("avg_revenue_per_customer") > 0),
            REVENUE_EACH,
            c("avg_revenue_per_customer"),
        ),
        sentence(
            has_customers & (c("avg_events_per_customer") > 0),
            EVENTS_EACH,
            c("avg_events_per_customer"),
        ),
        sentence(has_events, EVENTS_PROCESSED, c("total_cdr_events")),
        sentence(has_events & (c("total_revenue") > 0), REVENUE_TOTAL, c("total_revenue")),
        sentence(has_events & (c("total_revenue") <= 0), REVENUE_NONE),
        sentence(~has_events, EVENTS_NONE),
        sentence(has_offers, OFFERS_AVAILABLE, c("total_offers")),
        sentence(
            has_offers & (c("unique_active_offers") > 0),
            OFFERS_ACTIVE,
            c("unique_active_offers"),
            percent("unique_active_offers", "total_offers"),
        ),
        sentence(has_offers & (c("unique_active_offers") == 0), OFFERS_INACTIVE),
        sentence(
            c("most_popular_offer_subscribers") > 0,
            OFFER_LEADING,
            c("most_popular_offer"),
            c("most_popular_offer_subscribers"),
        ),
        sentence(
            c("most_popular_operation_events") > 0,
            OPERATION_LEADING,
            c("most_popular_operation"),
            c("most_popular_operation_events"),
        ),
        sentence(
            (c("most_popular_operation_events") > 0) & (c("unique_operation_types") > 0),
            OPERATIONS_USED,
            c("unique_operation_types"),
        ),
        sentence(
            c("unique_object_types_used") > 0,
            OBJECT_TYPES_IN_USE,
            c("unique_object_types_used"),
        ),
        sentence(c("unique_object_types_used") == 0, OBJECT_TYPES_NONE),
    ]
    stated = overall_stats(tables, as_of, active_years).select(
        F.posexplode(F.array_compact(F.array(*sentences))).alias("place", "conclusion")
    )
    return stated.select((F.col("place") + 1).cast("bigint").alias("conclusion_no"), "conclusion")


def sample_count(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    return tables["cdr_events"].agg(rows().alias("n"))


def sample_time_range(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    return tables["cdr_events"].agg(
        F.min("creation_time").alias("min_t"), F.max("creation_time").alias("max_t")
    )


def _most_frequent(tables: Tables, column: str, limit: int) -> DataFrame:
    return (
        tables["cdr_events"]
        .groupBy(column)
        .agg(rows().alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last(column))
        .limit(limit)
    )


def sample_top_offers(tables: Tables, as_of: datetime | None = None, limit: int = 5) -> DataFrame:
    """Most frequent offer ids; events without an offer count as one group."""
    return _most_frequent(tables, "offer_id", limit)


def sample_top_operations(
    tables: Tables, as_of: datetime | None = None, limit: int = 5
) -> DataFrame:
    return _most_frequent(tables, "operation_type_id", limit)
