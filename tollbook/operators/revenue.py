"""Revenue, ARPU, balance flow and loans."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.functions.calendar import month_label, month_start
from tollbook.functions.categories import LOAN_FRAGMENTS, mentions
from tollbook.functions.folds import folded_window
from tollbook.functions.measures import (
    USAGE_OPERATIONS,
    mean,
    mean_of_ratio,
    rows,
    rows_where,
    safe_ratio,
    total_or_zero,
    zero_if_null,
)
from tollbook.operators.customers import with_customer_type
from tollbook.sources.tables import Tables


def revenue_by_offer_month(
    tables: Tables,
    as_of: datetime | None = None,
    operations: Sequence[int] = USAGE_OPERATIONS,
) -> DataFrame:
    """Usage revenue per month and offer; events without a known offer form one group."""
    folded = (
        tables["cdr_events"]
        .filter(F.col("operation_type_id").isin(*operations))
        .groupBy(month_start(F.col("creation_time")).alias("month"), "offer_id")
        .agg(F.sum("deduct_amount").alias("deducted"))
    )
    return (
        folded.join(tables["offers"], "offer_id", "left")
        .groupBy("month", "offer_name")
        .agg(total_or_zero(F.col("deducted")).alias("revenue"))
        .withColumn("month", month_label(F.col("month")))
        .orderBy("month", "offer_name")
    )


def _monthly_by_type(tables: Tables, as_of: datetime, months: int) -> DataFrame:
    """Deductions per month and customer type, by way of one row per customer and month."""
    return (
        with_customer_type(folded_window(tables, "customer_months", as_of, months), tables)
        .groupBy("month", "cust_type")
        .agg(
            F.sum("deducted").alias("deducted"),
            F.sum("deductions").alias("deductions"),
            F.sum("events").alias("events"),
            rows().alias("customers"),
        )
        .withColumn("month", month_label(F.col("month")))
    )


def revenue_trend_by_type(tables: Tables, as_of: datetime, months: int = 18) -> DataFrame:
    return (
        _monthly_by_type(tables, as_of, months)
        .select(
            "month",
            "cust_type",
            F.col("deducted").cast("double").alias("monthly_revenue"),
            F.col("customers").alias("active_customers"),
            F.col("events").alias("total_transactions"),
            safe_ratio(F.col("deducted"), F.col("deductions")).alias("avg_transaction_value"),
        )
        .orderBy("month", "cust_type")
    )


def arpu(tables: Tables, as_of: datetime, months: int = 12) -> DataFrame:
    """Revenue per active user, per month and customer type, all operations counted."""
    return (
        _monthly_by_type(tables, as_of, months)
        .select(
            "month",
            "cust_type",
            F.col("customers").alias("active_users"),
            F.col("deducted").cast("double").alias("total_revenue"),
            safe_ratio(F.col("deducted"), F.col("customers")).alias("arpu"),
            safe_ratio(F.col("deducted"), F.col("deductions")).alias("avg_transaction_value"),
        )
        .orderBy("month", "cust_type")
    )


def balance_flow(tables: Tables, as_of: datetime, months: int = 12) -> DataFrame:
    """Money in, money out and the mean balance left, per month."""
    charged = F.sum(zero_if_null(F.col("charged")))
    deducted = F.sum(zero_if_null(F.col("deducted")))
    return (
        folded_window(tables, "customer_months", as_of, months)
        .groupBy("month")
        .agg(
            charged.cast("double").alias("total_charged"),
            deducted.cast("double").alias("total_deducted"),
            (charged - deducted).cast("double").alias("net_balance_change"),
            safe_ratio(F.sum("left_over"), F.sum("balances")).alias("avg_final_balance"),
            F.count("cust_num").alias("active_customers"),
        )
        .withColumn("month", month_label(F.col("month")))
        .orderBy("month")
    )


def _borrowers(tables: Tables, fragments: Sequence[str]) -> DataFrame:
    """Customers with a loan offer: loans, amount lent, and deductions on other offers.

    A loan event is what makes a borrower, so one fold with a filter on its loan count
    replaces the search for borrowers and the second reading of their events.
    """
    catalogue = tables["offers"].select(
        "offer_id", mentions(F.col("offer_name"), fragments).alias("is_loan")
    )
    is_loan = F.col("is_loan")
    # An amount that is NULL adds nothing, but all of them NULL leave the sum NULL.
    nothing = F.lit(0).cast("decimal(15,2)")
    folded = (
        tables["cdr_events"]
        .join(catalogue, "offer_id")
        .groupBy("cust_num")
        .agg(
            rows_where(is_loan).alias("loans"),
            F.sum(F.when(is_loan, F.col("charge_amount")).otherwise(nothing)).alias("lent"),
            F.sum(F.when(is_loan, nothing).otherwise(F.col("deduct_amount"))).alias("repaid"),
        )
        .filter(F.col("loans") > 0)
    )
    return with_customer_type(folded, tables)


def loan_analysis(
    tables: Tables,
    as_of: datetime | None = None,
    fragments: Sequence[str] = LOAN_FRAGMENTS,
    risk_share: Decimal = Decimal("0.5"),
) -> DataFrame:
    """Loans, repayment and risk per customer type."""
    lent, repaid = F.col("lent"), F.col("repaid")
    return (
        _borrowers(tables, fragments)
        .groupBy("cust_type")
        .agg(
            rows().alias("loan_customers"),
            mean(F.col("loans")).alias("avg_loans_per_customer"),
            mean(lent).alias("avg_total_loan_amount"),
            mean(repaid).alias("avg_total_repayments"),
            mean_of_ratio(safe_ratio(repaid, lent)).alias("avg_repayment_ratio"),
            rows_where(repaid >= lent).alias("customers_fully_repaid"),
            rows_where(repaid < lent * F.lit(risk_share)).alias("high_risk_customers"),
        )
    )


def loan_risk_split(
    tables: Tables,
    as_of: datetime | None = None,
    fragments: Sequence[str] = LOAN_FRAGMENTS,
    risk_share: Decimal = Decimal("0.5"),
) -> DataFrame:
    """Borrowers at low and at high risk."""
    at_risk = F.coalesce(F.sum("high_risk_customers"), F.lit(0))
    borrowers = F.coalesce(F.sum("loan_customers"), F.lit(0))
    return (
        loan_analysis(tables, as_of, fragments, risk_share)
        .agg(
            F.array(
                F.struct(F.lit("Low Risk").alias("risk"), (borrowers - at_risk).alias("customers")),
                F.struct(F.lit("High Risk").alias("risk"), at_risk.alias("customers")),
            ).alias("split")
        )
        .select(F.inline("split"))
    )
