"""Cases the sample tables do not reach: ties, NULLs, borders, empty tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from star_rows import NOW, event, keyed, rows_of
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
from tollbook.plans.reports import REPORTS, refresh_reports

DAY = timedelta(days=1)
CATALOGUE = [(1, "Pass Data"), (2, "10 min"), (3, "Loan_Cash"), (4, "Plain"), (5, "Idle Data")]


@pytest.mark.parametrize("name", REPORTS)
def test_every_report_runs_on_an_empty_store(star, name):
    assert isinstance(REPORTS[name](star(), NOW).collect(), list)


def test_empty_store_defaults(star):
    stats = rows_of(kpis.overall_stats(star(), NOW))[0]
    assert stats["most_popular_offer"] == "N/A"
    assert stats["most_popular_operation_events"] == 0
    assert stats["avg_revenue_per_customer"] == 0.0
    summary = rows_of(kpis.kpi_summary(star(), NOW))[0]
    assert summary["total_revenue"] == 0.0 and summary["arpu"] == 0.0
    snapshot = keyed(monitoring.activity_snapshot(star(), NOW), "metric_type")
    assert set(snapshot) == {"current_hour", "today", "yesterday"}
    assert snapshot["today"]["event_count"] == 0 and snapshot["today"]["total_revenue"] is None
    told = [r["conclusion"] for r in kpis.overall_conclusions(star(), NOW).collect()]
    assert kpis.EVENTS_NONE in told and kpis.OBJECT_TYPES_NONE in told
    assert kpis.OFFERS_INACTIVE in told and len(told) == 4


def test_dashboard_cuts_sums_before_dividing(star):
    tables = star(
        [
            event(1, 1, NOW - DAY, deduct_amount="10.99"),
            event(2, 2, NOW - DAY, deduct_amount="0.99", operation_type_id=5),
        ],
        customers=[(1, "S"), (2, "A"), (3, "A"), (4, "A")],
    )
    card = rows_of(kpis.dashboard_kpis(tables, NOW))[0]
    assert (card["total_revenue"], card["arpu"]) == (11, 2.75)
    # The summary counts usage operations only, and does not cut.
    assert rows_of(kpis.kpi_summary(tables, NOW))[0]["total_revenue"] == 10.99


def test_future_events_count_in_trailing_windows(star):
    tables = star([event(1, 1, NOW + 40 * DAY, deduct_amount=5)], customers=[(1, "S")])
    assert rows_of(revenue.arpu(tables, NOW))[0]["month"] == "2024-05"
    assert rows_of(kpis.kpi_summary(tables, NOW))[0]["active_customers"] == 1


def test_window_border_is_inside(star):
    border = datetime(2023, 3, 31, 12, 0)
    tables = star(
        [event(1, 1, border, deduct_amount=5), event(2, 2, border - timedelta(seconds=1), deduct_amount=7)],
        customers=[(1, "S"), (2, "S")],
    )
    assert rows_of(revenue.arpu(tables, NOW))[0]["active_users"] == 1


def test_arpu_of_null_amounts(star):
    tables = star([event(1, 1, NOW)], customers=[(1, "S")])
    row = rows_of(revenue.arpu(tables, NOW))[0]
    assert (row["total_revenue"], row["arpu"], row["active_users"]) == (None, None, 1)


def test_spending_segments_with_unknown_totals(star):
    events = [event(i, i, NOW, deduct_amount=None if i <= 6 else i) for i in range(1, 11)]
    tables = star(events, customers=[(i, "S") for i in range(1, 11)])
    # Six unknown totals come first: the median is unknown, the fourth fifth is 8.
    got = keyed(customers.customer_spending_segments(tables), "spending_segment")
    assert {k: v["customer_count"] for k, v in got.items()} == {"High Value": 3, "Low Value": 7}
    assert got["Low Value"]["avg_total_spent"] == 7.0


def test_segments_cover_every_customer_once(star):
    events = [event(i, i % 7, NOW, deduct_amount=i % 3) for i in range(50)]
    tables = star(events, customers=[(i, "SA"[i % 2]) for i in range(7)])
    got = rows_of(customers.customer_spending_segments(tables))
    assert sum(r["customer_count"] for r in got) == 7


def test_preference_ties_go_by_name_and_spending_counts_everything(star):
    events = [
        event(1, 1, NOW, offer_id=2, deduct_amount=1),
        event(2, 1, NOW, offer_id=1, deduct_amount=2),
        event(3, 1, NOW, offer_id=None, deduct_amount=10),
        event(4, 1, NOW, offer_id=99, deduct_amount=20),
        event(5, 2, NOW, offer_id=3, deduct_amount=5),
        event(6, 3, NOW, offer_id=None, deduct_amount=5),
    ]
    got = keyed(customers.customer_offer_preferences(star(events, offers=CATALOGUE)), "user_segment")
    # "10 min" comes before "Pass Data"; customer 3 has no known offer and no segment.
    assert got["Voice-centric users"]["avg_customer_value"] == 33.0
    assert got["Loan takers"]["customer_count"] == 1
    assert set(got) == {"Voice-centric users", "Loan takers"}


def test_lifecycle_needs_five_charges(star):
    def charges(cust, n):
        return [
            event(
                cust * 100 + i, cust, NOW, charge_amount=10,
                charge_expire_time=NOW + timedelta(hours=10 + i),
                current_amount_expire_time=NOW - timedelta(minutes=90),
            )
            for i in range(n)
        ]

    tables = star(charges(1, 5) + charges(2, 4), customers=[(1, "S"), (2, "S")])
    row = rows_of(customers.customer_lifecycle(tables))
    assert [r["cust_num"] for r in row] == [1]
    assert row[0]["avg_charge_lifetime_hours"] == 12.0
    assert row[0]["avg_current_lifetime_hours"] == -1.0


def test_journey_stages_at_their_borders(star):
    start = datetime(2024, 1, 1, 23, 0)
    days = [0, 7, 8, 30, 31, 90, 91]
    times = [start + d * DAY - timedelta(hours=22 if d else 0) for d in days]
    events = [event(i, 1, t, offer_id=1, deduct_amount=1) for i, t in enumerate(times)]
    tables = star(events, offers=CATALOGUE)
    got = rows_of(customers.customer_journey(tables, datetime(2024, 4, 30)))
    assert [(r["journey_stage"], r["avg_transactions"]) for r in got] == [
        ("New Customer (0-7 days)", 2.0),
        ("Early Stage (8-30 days)", 2.0),
        ("Growing (31-90 days)", 2.0),
        ("Mature (90+ days)", 1.0),
    ]
    funnel = rows_of(customers.journey_funnel(tables, datetime(2024, 4, 30)))
    assert {r["pct_initial"] for r in funnel} == {100.0}


def test_sequence_runs_on_across_minutes(star):
    events = [event(i, 1, NOW - timedelta(minutes=20 * i), offer_id=1) for i in range(10)]
    got = customers.journey_sequence(star(events, offers=CATALOGUE), NOW).collect()
    ordered = sorted(got, key=lambda r: r["creation_time"])
    assert [r["transaction_sequence"] for r in ordered] == list(range(1, 11))


def test_offers_without_events_show_zeros(star):
    got = keyed(offers.offers_summary(star(offers=CATALOGUE)), "offer_id")
    assert got[5]["subscriber_count"] == 0 and got[5]["avg_deduct_amount"] == 0.0
    got = keyed(offers.data_bundles(star(offers=CATALOGUE)), "offer_id")
    assert set(got) == {1, 5}


def test_daily_rate_on_the_first_day_is_unknown(star):
    tables = star([event(1, 1, NOW, offer_id=1, deduct_amount=4)], offers=CATALOGUE)
    row = rows_of(offers.competitive(tables, NOW))[0]
    assert row["daily_revenue"] is None and row["total_revenue"] == 4.0


def test_equal_revenue_shares_a_rank(star):
    events = [event(i, i, NOW, offer_id=i, deduct_amount=4) for i in (1, 5)]
    got = rows_of(offers.competitive(star(events, offers=CATALOGUE), NOW))
    assert [r["revenue_rank"] for r in got] == [1, 1]


def test_loans_without_amount(star):
    events = [
        event(1, 1, NOW, offer_id=3, charge_amount=0),
        event(2, 1, NOW, offer_id=1, deduct_amount=5),
        event(3, 2, NOW, offer_id=3, charge_amount=10),
        event(4, 2, NOW, offer_id=1, deduct_amount="4.99"),
        event(5, 3, NOW, offer_id=1, deduct_amount=5),
    ]
    tables = star(events, customers=[(1, "S"), (2, "S"), (3, "S")], offers=CATALOGUE)
    row = rows_of(revenue.loan_analysis(tables))[0]
    assert row["loan_customers"] == 2
    assert row["avg_repayment_ratio"] == 0.499
    assert (row["customers_fully_repaid"], row["high_risk_customers"]) == (1, 1)
    split = keyed(revenue.loan_risk_split(tables), "risk")
    assert (split["Low Risk"]["customers"], split["High Risk"]["customers"]) == (1, 1)


def test_expiry_grain(star):
    objects = [
        (1, 1, 1, datetime(2024, 4, 1, 1)),
        (2, 1, 1, datetime(2024, 4, 1, 2)),
        (3, 2, 1, datetime(2020, 1, 1)),
        (4, 2, 1, None),
        (5, 2, 1, datetime(2025, 4, 1)),
    ]
    tables = star(objects=objects)
    raw = rows_of(operations.expiry_forecast(tables, NOW))
    daily = rows_of(operations.expiry_forecast(tables, NOW, grain="day"))
    assert [r["expiring_objects"] for r in raw] == [1, 1, 1]
    assert [r["expiring_objects"] for r in daily] == [1, 2]


def test_expiry_status_without_expired_balances(star):
    events = [
        event(1, 1, NOW, charge_amount=10, charge_expire_time=NOW - DAY),
        event(2, 2, NOW, charge_amount=10, charge_expire_time=NOW),
        event(3, 3, NOW, charge_amount=10),
    ]
    got = keyed(operations.expiry_impact(star(events), NOW), "expiry_status")
    assert {k: v["customer_count"] for k, v in got.items()} == {
        "Has Expired Balances": 1,
        "No Expired Balances": 1,
    }


def test_capacity_levels(star):
    events = []
    for hour, n in ((1, 1), (2, 10), (3, 20)):
        for i in range(n):
            events.append(event(len(events), i, datetime(2024, 3, 30, hour), offer_id=1))
    got = keyed(operations.network_capacity(star(events, offers=CATALOGUE), NOW), "usage_hour")
    assert {h: r["capacity_status"] for h, r in got.items()} == {
        1: "Low Usage",
        2: "Normal Usage",
        3: "Peak Hours",
    }


def test_report_keeps_unknown_mean_apart_from_zero_counts(star):
    report = keyed(quality.data_quality_report(star([event(1, 1, NOW)]), NOW), "check_type")
    assert report["Amount Anomalies"]["avg_deduct"] is None
    assert report["Timestamp Issues"]["negative_charges"] == 0
    assert report["Customer Consistency"]["orphaned_customers"] == 1


def test_deviation_is_of_the_population(star):
    events = [event(i, 1, NOW, deduct_amount=a) for i, a in enumerate((2, 4))]
    row = rows_of(quality.dq_amount_anomalies(star(events)))[0]
    assert row["stddev_deduct"] == 1.0


def test_risk_levels_at_their_borders(star):
    events = []
    for cust, (days, n) in enumerate(((31, 9), (30, 9), (15, 9), (14, 4), (14, 5), (0, 2))):
        events += [event(cust * 100 + i, cust, NOW - days * DAY, deduct_amount=1) for i in range(n)]
    tables = star(events, customers=[(c, "S") for c in range(6)])
    flags = keyed(churn.customer_churn_flags(tables, NOW), "cust_num")
    assert [flags[c]["churn_risk_level"] for c in range(6)] == [
        "High Risk", "Medium Risk", "Medium Risk", "Low Engagement", "Active", "Low Engagement",
    ]
    assert [flags[c]["churn_flag"] for c in range(6)] == [1, 0, 0, 0, 0, 1]


def test_customers_without_events_have_no_churn_quarter(star):
    tables = star([event(1, 1, NOW - 91 * DAY), event(2, 2, NOW - 90 * DAY)], customers=[(1, "S"), (2, "S"), (3, "S")])
    assert rows_of(churn.churn_by_quarter(tables, NOW)) == [{"period": "2023-Q4", "churn_count": 1}]


def test_lapsed_offer_of_an_active_customer(star):
    events = [event(1, 1, NOW - 100 * DAY, offer_id=1), event(2, 1, NOW, offer_id=2)]
    got = rows_of(churn.churn_by_offer(star(events, offers=CATALOGUE), NOW))
    assert [(r["offer_id"], r["churned_customers"]) for r in got] == [(1, 1)]


def test_seasons_compare_months_over_years(star):
    events = []
    for year, month, amount in ((2022, 6, 100), (2023, 6, 300), (2023, 7, 100), (2023, 8, 150)):
        events.append(event(len(events), 1, datetime(year, month, 5), deduct_amount=amount))
    got = keyed(churn.seasonality(star(events), NOW), "month")
    assert got[6]["data_points"] == 2 and got[6]["revenue_volatility"] == 100.0
    assert [got[m]["season_type"] for m in (6, 7, 8)] == ["Peak Season", "Low Season", "Normal Season"]
    assert got[6]["month_name"] == "June"


def test_snapshot_spans(star):
    as_of = datetime(2024, 3, 31, 0, 30)
    times = [
        datetime(2024, 3, 30, 23, 45),  # last hour and yesterday
        datetime(2024, 3, 31, 0, 10),  # last hour and today
        datetime(2024, 4, 2),  # after the day: last hour only
        datetime(2024, 3, 29, 23, 59),  # none
    ]
    tables = star([event(i, i, t, deduct_amount=1) for i, t in enumerate(times)])
    got = keyed(monitoring.activity_snapshot(tables, as_of), "metric_type")
    assert {k: v["event_count"] for k, v in got.items()} == {
        "current_hour": 3, "today": 1, "yesterday": 1,
    }


@pytest.mark.parametrize(("minutes", "status"), [(60, monitoring.HEALTHY), (61, monitoring.STALE)])
def test_health_border(star, minutes, status):
    tables = star([event(1, 1, NOW - timedelta(minutes=minutes))])
    assert monitoring.health_status(tables, NOW).first()["health_status"] == status


def test_lookup_of_one_customer(star):
    events = [event(i, 1, NOW - timedelta(minutes=i), deduct_amount=1) for i in range(150)]
    events += [event(1000, 2, NOW)]
    tables = star(events, customers=[(1, "S"), (2, "A")], objects=[(10, 1, 1, NOW), (11, 1, 2, None)])
    recent = profiles.customer_recent_events(tables, customers=[1]).collect()
    assert sorted(r["cdr_event_id"] for r in recent) == list(range(100))
    profile = rows_of(profiles.customer_profile(tables, customers=[1]))
    assert {r["section"]: sum(q["section"] == r["section"] for q in profile) for r in profile} == {
        "customer_info": 1, "objects": 2, "cdr_events": 100,
    }
    assert profiles.customer_profile(tables, customers=[404]).count() == 0
    assert profiles.object_profile(tables, objects=[10]).count() == 100
    assert profiles.object_profile(tables, objects=[11]).count() == 1


def test_refresh_writes_reports(spark, star, tmp_path):
    tables = star([event(1, 1, NOW, offer_id=1, deduct_amount=3)], customers=[(1, "S")], offers=CATALOGUE)
    refresh_reports(tables, NOW, str(tmp_path), ["arpu", "offers_summary"])
    refresh_reports(tables, NOW, str(tmp_path), ["arpu"])
    assert spark.read.parquet(str(tmp_path / "arpu")).first()["arpu"] == 3.0
    assert spark.read.parquet(str(tmp_path / "offers_summary")).count() == 5


def test_decimal_sums_are_exact(star):
    events = [event(i, 1, NOW, deduct_amount=Decimal("0.10")) for i in range(1000)]
    row = rows_of(revenue.arpu(star(events, customers=[(1, "S")]), NOW))[0]
    assert row["total_revenue"] == 100.0
