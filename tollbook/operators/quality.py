"""Data-quality checks over the stored facts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollbook.functions.calendar import moment
from tollbook.functions.measures import mean, rows, rows_where, safe_ratio
from tollbook.sources.tables import Tables

OLDEST_PLAUSIBLE = datetime(2020, 1, 1)


def _per_offer(tables: Tables) -> DataFrame:
    return tables["cdr_events"].groupBy("offer_id").agg(
        rows().alias("n"), F.sum("deduct_amount").alias("spent"), F.count("deduct_amount").alias("spent_n")
    )


def _unmatched(per_offer: DataFrame, tables: Tables) -> DataFrame:
    catalogue = tables["offers"].select(F.col("offer_id").alias("known_offer"))
    unknown = F.col("offer_id").isNotNull() & F.col("known_offer").isNull()
    sums = per_offer.join(
        catalogue, F.col("offer_id") == F.col("known_offer"), "left"
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("unmatched"),
    )
    return sums.select(
        F.lit("Offer ID Consistency").alias("check_type"),
        "total_records",
        F.col("unmatched").alias("inconsistent_records_no_match"),
        F.lit(0).cast("bigint").alias("inconsistent_records_mismatch"),
        (safe_ratio(F.col("unmatched"), F.col("total_records")) * 100).alias("inconsistency_rate"),
    )


def dq_offer_consistency(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Facts whose offer is not in the catalogue.

    Facts are matched by offer id, so a matched fact never names another offer: the count
    of mismatches is part of the report and always zero.
    """
    per_offer = tables["cdr_events"].groupBy("offer_id").agg(rows().alias("n"))
    return _unmatched(per_offer, tables)


def dq_amount_anomalies(
    tables: Tables, as_of: datetime | None = None, high_factor: float = 10
) -> DataFrame:
    """Negative amounts, and deductions far above the mean."""
    facts = tables["cdr_events"]
    level = facts.agg(mean(F.col("deduct_amount"))).scalar()
    measures = [rows().alias("total_records"), *_amount_measures(level, high_factor)]
    return facts.agg(*measures).select(F.lit("Amount Anomalies").alias("check_type"), "*")


def _amount_measures(level: Column, high_factor: float = 10) -> list[Column]:
    deducted = F.col("deduct_amount")
    return [
        rows_where(deducted < 0).alias("negative_deductions"),
        rows_where(F.col("charge_amount") < 0).alias("negative_charges"),
        rows_where(deducted.cast("double") > level * high_factor).alias("high_deductions"),
        mean(deducted).alias("avg_deduct"),
        F.round(F.stddev_pop(deducted.cast("double")), 6).alias("stddev_deduct"),
    ]


def dq_timestamp_issues(
    tables: Tables, as_of: datetime, oldest: datetime = OLDEST_PLAUSIBLE
) -> DataFrame:
    """Facts dated in the future, implausibly early, or expiring before they begin."""
    measures = [rows().alias("total_records"), *_time_measures(as_of, oldest)]
    timed = tables["cdr_events"].agg(*measures)
    return timed.select(F.lit("Timestamp Issues").alias("check_type"), "*")


def _time_measures(as_of: datetime, oldest: datetime = OLDEST_PLAUSIBLE) -> list[Column]:
    created = F.col("creation_time")
    return [
        rows_where(created > moment(as_of)).alias("future_timestamps"),
        rows_where(created < moment(oldest)).alias("very_old_timestamps"),
        rows_where(F.col("charge_expire_time") < created).alias("invalid_expiry_times"),
    ]


def dq_customer_consistency(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Customers with events that the master does not know."""
    seen = tables["cdr_events"].select("cust_num").distinct()
    sums = seen.join(
        tables["customers"], F.col("cust_num") == F.col("cust_num_bigint"), "left"
    ).agg(
        F.count("cust_num").alias("customers_in_events"),
        F.count("cust_num_bigint").alias("customers_in_master"),
    )
    return sums.select(
        F.lit("Customer Consistency").alias("check_type"),
        "customers_in_events",
        "customers_in_master",
        (F.col("customers_in_events") - F.col("customers_in_master")).alias("orphaned_customers"),
    )


REPORT_COUNTS = (
    "total_records",
    "inconsistent_records_no_match",
    "inconsistent_records_mismatch",
    "negative_deductions",
    "negative_charges",
    "high_deductions",
    "future_timestamps",
    "very_old_timestamps",
    "invalid_expiry_times",
    "customers_in_events",
    "customers_in_master",
    "orphaned_customers",
    "inconsistency_rate",
)


def data_quality_report(tables: Tables, as_of: datetime) -> DataFrame:
    """All four checks in one layout; what a check does not measure is 0, or NULL for the
    mean and the deviation."""
    per_offer = _per_offer(tables)
    level = per_offer.agg(safe_ratio(F.sum("spent"), F.sum("spent_n"))).scalar()
    amounts, times = _amount_measures(level), _time_measures(as_of)
    once = tables["cdr_events"].agg(rows().alias("total_records"), *amounts, *times)
    names = once.columns[1:]

    def line(check: str, own: list[str]) -> Column:
        kept = [F.when(F.lit(name in own), F.col(name)).alias(name) for name in names]
        return F.struct(F.lit(check).alias("check_type"), "total_records", *kept)

    of_amounts = names[: len(amounts)]
    lines = F.array(
        line("Amount Anomalies", of_amounts), line("Timestamp Issues", names[len(amounts) :])
    )
    # Amounts and times take one pass; the mean before it comes from a fold by offer.
    checks = [
        _unmatched(per_offer, tables),
        once.select(F.inline(lines)),
        dq_customer_consistency(tables),
    ]
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check, allowMissingColumns=True)
    return report.select(
        "check_type",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in REPORT_COUNTS],
        "avg_deduct",
        "stddev_deduct",
    )
