"""Physical plans: what reaches the scan, what is shuffled, and what must not appear."""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

import pytest

from star_rows import event
from tollbook.plans.reports import REPORTS
from tollbook.sources.tables import append_table, create_store, load_tables

AS_OF = datetime(2024, 6, 30, 12)


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    root = str(tmp_path_factory.mktemp("plans") / "store")
    create_store(spark, root)
    events = [
        event(m * 10 + i, i, datetime(2022 + m // 12, m % 12 + 1, 5), offer_id=1482110, deduct_amount=Decimal(i))
        for m in range(30)
        for i in range(5)
    ]
    tables = star(events, customers=[(i, "S") for i in range(5)], objects=[(i * 10, i, 1, AS_OF) for i in range(5)])
    for name in ("customers", "objects", "cdr_events"):
        append_table(tables[name], root, name)
    return load_tables(spark, root)


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def fact_scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and "cdr_events" in line]


@pytest.mark.parametrize("name", REPORTS)
def test_no_products_and_no_python(stored, name):
    plan = plan_of(REPORTS[name](stored, AS_OF))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert forbidden not in plan


TRAILING = {
    "customer_journey": "2023-12", "journey_sequence": "2023-12", "offer_trend": "2023-06",
    "cross_offer": "2023-12", "revenue_trend_by_type": "2022-12", "arpu": "2023-06",
    "balance_flow": "2023-06", "daily_series": "2019-06", "usage_patterns": "2024-03",
    "usage_heatmap": "2024-03", "network_capacity": "2024-06", "seasonality": "2022-06",
    "activity_snapshot": "2024-06",
}


@pytest.mark.parametrize("name", TRAILING)
def test_trailing_windows_prune_months_and_push_the_bound(stored, name):
    scans = fact_scans(plan_of(REPORTS[name](stored, AS_OF)))
    assert scans
    for scan in scans:
        partitions = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
        assert f">= {TRAILING[name]}" in partitions
        assert "GreaterThanOrEqual(creation_time" in scan


def test_scans_read_only_the_columns_they_need(stored):
    narrow = {
        "sample_top_operations": {"operation_type_id"},
        "top_offer": {"cust_num", "offer_id"},
        "dq_customer_consistency": {"cust_num"},
        "balance_flow": {"creation_time", "cust_num", "deduct_amount", "charge_amount", "current_amount_post"},
        "churn_by_offer": {"creation_time", "cust_num", "offer_id"},
    }
    for name, columns in narrow.items():
        for scan in fact_scans(plan_of(REPORTS[name](stored, AS_OF))):
            schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
            read = {part.split(":")[0] for part in re.findall(r"\w+:\w+(?:\(\d+,\d+\))?", schema)}
            assert read == columns, name


# How often each report goes through the facts.
PASSES = {
    "arpu": 1, "offer_performance": 1, "offer_trend_top10": 1, "loan_analysis": 1,
    "customer_offer_preferences": 1, "customer_journey": 1, "next_offer": 1, "expiry_impact": 1,
    "network_capacity": 1, "seasonality": 1, "churn_risk": 1, "competitive": 1,
    "activity_snapshot": 1,
    # The mean must be known before amounts can be held against it.
    "dq_amount_anomalies": 2, "data_quality_report": 4,
}


@pytest.mark.parametrize("name", PASSES)
def test_facts_are_read_once(stored, name):
    assert len(fact_scans(plan_of(REPORTS[name](stored, AS_OF)))) == PASSES[name]


def single_partition_inputs(plan: str) -> list[str]:
    """The operator under every exchange to one partition, projections aside."""
    lines = [line for line in plan.splitlines() if "- Project" not in line]
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


@pytest.mark.parametrize("name", REPORTS)
def test_one_partition_only_gets_folded_rows(stored, name):
    for below in single_partition_inputs(plan_of(REPORTS[name](stored, AS_OF))):
        assert "Aggregate" in below or "LocalLimit" in below, below


@pytest.mark.parametrize(
    "name", ["arpu", "customer_behavior_by_type", "customer_journey", "next_offer", "loan_analysis", "churn_risk"]
)
def test_facts_are_folded_before_the_first_shuffle(stored, name):
    lines = plan_of(REPORTS[name](stored, AS_OF)).splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-*")) for i, line in enumerate(lines)}
    for i, line in enumerate(lines):
        if "FileScan" in line and "cdr_events" in line:
            above = i
            while above > 0:
                parent = max(j for j in range(above) if depth[j] < depth[above])
                if "Exchange" in lines[parent]:
                    assert "partial_" in lines[parent + 1]
                    break
                above = parent


def test_spending_folds_the_facts_once(stored):
    report = REPORTS["customer_spending_segments"](stored, AS_OF)
    report.collect()
    assert "ReusedExchange [cust_num" in plan_of(report)


@pytest.mark.parametrize("name", ["customer_recent_events", "object_profile"])
def test_top_rows_are_cut_before_the_shuffle(stored, name):
    plan = plan_of(REPORTS[name](stored, AS_OF))
    assert "row_number(), 100, Partial" in plan and "_salt" in plan
