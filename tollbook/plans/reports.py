"""All analytic reports by name, and the job that refreshes them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame

from tollbook.operators import (
    churn,
    customers,
    kpis,
    monitoring,
    offers,
    operations,
    profiles,
    quality,
    revenue,
)
from tollbook.sources.tables import Tables

Report = Callable[..., DataFrame]

REPORTS: dict[str, Report] = {
    report.__name__: report
    for report in (
        kpis.dashboard_kpis,
        kpis.kpi_summary,
        kpis.overall_stats,
        kpis.top_offer,
        kpis.top_operation,
        kpis.object_types_used,
        kpis.overall_conclusions,
        kpis.sample_count,
        kpis.sample_time_range,
        kpis.sample_top_offers,
        kpis.sample_top_operations,
        customers.customer_type_distribution,
        customers.customer_spending_segments,
        customers.customer_behavior_by_type,
        customers.customer_offer_preferences,
        customers.customer_lifecycle,
        customers.customer_journey,
        customers.journey_funnel,
        customers.journey_sequence,
        profiles.customer_profile,
        profiles.customer_objects,
        profiles.customer_recent_events,
        profiles.object_profile,
        offers.offers_summary,
        offers.offer_performance,
        offers.offer_trend,
        offers.offer_trend_top10,
        offers.data_bundles,
        offers.cross_offer,
        offers.customer_offer_list,
        offers.competitive,
        offers.next_offer,
        revenue.revenue_by_offer_month,
        revenue.revenue_trend_by_type,
        revenue.arpu,
        revenue.balance_flow,
        revenue.loan_analysis,
        revenue.loan_risk_split,
        operations.operations_breakdown,
        operations.object_types_analysis,
        operations.daily_series,
        operations.usage_patterns,
        operations.usage_heatmap,
        operations.expiry_forecast,
        operations.expiry_impact,
        operations.network_capacity,
        quality.dq_offer_consistency,
        quality.dq_amount_anomalies,
        quality.dq_timestamp_issues,
        quality.dq_customer_consistency,
        quality.data_quality_report,
        churn.churn_by_quarter,
        churn.churn_by_offer,
        churn.churn_risk,
        churn.customer_churn_flags,
        churn.seasonality,
        monitoring.activity_snapshot,
        monitoring.system_health,
        monitoring.health_status,
    )
}

# Lookups of single keys; a refresh for all customers and objects would copy the facts.
LOOKUPS = frozenset(
    ("customer_profile", "customer_objects", "customer_recent_events", "object_profile")
)


def refresh_reports(
    tables: Tables,
    as_of: datetime,
    target: str,
    names: Iterable[str] | None = None,
    at_once: int = 4,
) -> list[str]:
    """Write each report to its own Parquet folder, replacing the last refresh.

    ``at_once`` reports are submitted together, so that one's last tasks leave no cores idle.
    """
    chosen = [n for n in REPORTS if n not in LOOKUPS] if names is None else list(names)

    def refresh(name: str) -> None:
        report = REPORTS[name](tables, as_of)
        report.write.mode("overwrite").parquet(os.path.join(target, name))

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(refresh, chosen))
    return chosen
