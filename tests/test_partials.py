"""Stored partials: only months that changed are folded, and reports from them equal those from facts."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path
from threading import Barrier

import pyarrow.parquet as pq
import pytest

from star_rows import event, rows_of
from tollbook.functions.folds import FOLDS
from tollbook.plans import partials
from tollbook.plans.partials import approximate_spending, load_partials, refresh_partials, tables_with_partials
from tollbook.plans.reports import REPORTS
from tollbook.sources.tables import append_table, create_store, load_tables, reset_facts

AS_OF = datetime(2024, 6, 17, 15, 30)
NAMES = ("arpu", "revenue_trend_by_type", "balance_flow", "offer_trend", "offer_trend_top10")


def some_events(rng, count, first, start, days):
    offers = [1482110, 1050552, 3771305, None, 77]
    amount = lambda: rng.choice([None, Decimal(rng.randrange(0, 900)) / 100])
    return [
        event(
            first + n, rng.choice([*range(30), 999]), start + timedelta(minutes=rng.randrange(days * 24 * 60)), offer_id=rng.choice(offers),
            deduct_amount=amount(), charge_amount=amount(), current_amount_post=amount(),
        )
        for n in range(count)
    ]


@pytest.fixture
def store(spark, star, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)

    def append(events):
        tables = star(events, customers=[(i, "AS"[i % 2]) for i in range(30)])
        if not load_tables(spark, root)["customers"].count():
            append_table(tables["customers"], root, "customers")
        append_table(tables["cdr_events"], root, "cdr_events")

    return root, append


def same_reports(spark, root):
    facts, partials = load_tables(spark, root), tables_with_partials(spark, root)
    for name in NAMES:
        expected, got = (sorted(map(tuple, REPORTS[name](tables, AS_OF).collect()), key=str) for tables in (facts, partials))
        assert got == expected, name


def test_only_touched_months_are_folded(spark, store):
    root, append = store
    rng = random.Random(1)
    append(some_events(rng, 300, 0, datetime(2023, 4, 1), 430))
    months = refresh_partials(spark, root)
    assert len(months) == 15 and months[0] == "2023-04"
    same_reports(spark, root)
    assert refresh_partials(spark, root) == []
    append(some_events(rng, 20, 1_000, datetime(2023, 8, 3), 10) + some_events(rng, 20, 2_000, datetime(2024, 7, 2), 5))
    before = {r["event_month"]: r["n"] for r in load_partials(spark, root)["customer_months"].groupBy("event_month").agg({"events": "sum"}).withColumnRenamed("sum(events)", "n").collect()}
    assert refresh_partials(spark, root) == ["2023-08", "2024-07"]
    after = {r["event_month"]: r["n"] for r in load_partials(spark, root)["customer_months"].groupBy("event_month").agg({"events": "sum"}).withColumnRenamed("sum(events)", "n").collect()}
    assert {m: after[m] - before.get(m, 0) for m in after if after[m] != before.get(m)} == {"2023-08": 20, "2024-07": 20}
    same_reports(spark, root)


def test_facts_are_read_for_the_first_month_only(spark, store):
    root, append = store
    append(some_events(random.Random(2), 200, 0, datetime(2023, 4, 1), 430))
    refresh_partials(spark, root)
    tables = tables_with_partials(spark, root)
    for name, month in (("arpu", "2023-06"), ("balance_flow", "2023-06"), ("revenue_trend_by_type", "2022-12"), ("offer_trend", "2023-06")):
        plan = REPORTS[name](tables, AS_OF)._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "creation_time#" in line]
        assert scans and all(re.search(rf"event_month#\d+ = {month}", line) for line in scans), name


def test_a_reset_empties_the_partials(spark, store):
    root, append = store
    append(some_events(random.Random(3), 50, 0, datetime(2024, 4, 1), 60))
    refresh_partials(spark, root)
    reset_facts(spark, root)
    assert refresh_partials(spark, root) == []
    assert all(not frame.count() for frame in load_partials(spark, root).values())
    same_reports(spark, root)
    got = rows_of(approximate_spending(tables_with_partials(spark, root), AS_OF))
    assert got == [{"active_customers": 0, "spending": None}]


def test_an_empty_store(spark, store):
    root, _ = store
    assert refresh_partials(spark, root) == []
    same_reports(spark, root)


def test_sketches_stay_within_their_error(spark, star, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    rng = random.Random(4)
    events = [
        event(n, rng.randrange(20_000), datetime(2023, 7, 1) + timedelta(days=rng.randrange(340)), deduct_amount=Decimal(rng.randrange(100_000)) / 100)
        for n in range(12_000)
    ]
    append_table(star(events)["cdr_events"], root, "cdr_events")
    refresh_partials(spark, root)
    [got] = rows_of(approximate_spending(tables_with_partials(spark, root), AS_OF, shares=(0.1, 0.5, 0.9)))
    exact = len({e["cust_num"] for e in events})
    assert abs(got["active_customers"] - exact) < 0.05 * exact
    months: dict = {}
    for e in events:
        key = e["cust_num"], e["creation_time"].strftime("%Y-%m")
        months[key] = months.get(key, Decimal(0)) + e["deduct_amount"]
    for share, value in zip((0.1, 0.5, 0.9), got["spending"], strict=True):
        assert abs(sum(float(m) <= value for m in months.values()) / len(months) - share) < 0.02


def test_folds_run_side_by_side(spark, store, monkeypatch):
    root, append = store
    append(some_events(random.Random(5), 50, 0, datetime(2024, 4, 1), 60))
    together = Barrier(len(FOLDS), timeout=60)

    def met(fold):
        return lambda facts: together.wait() is not None and fold(facts)

    monkeypatch.setattr(partials, "FOLDS", {name: met(fold) for name, fold in FOLDS.items()})
    assert refresh_partials(spark, root) == ["2024-04", "2024-05"]
    same_reports(spark, root)


def test_a_failed_fold_is_raised_and_made_good(spark, store, monkeypatch):
    root, append = store
    append(some_events(random.Random(6), 50, 0, datetime(2024, 4, 1), 60))

    def cut_short(facts):
        raise ValueError("cut short")

    with monkeypatch.context() as broken:
        broken.setattr(partials, "FOLDS", {**FOLDS, "offer_months": cut_short})
        with pytest.raises(ValueError, match="cut short"):
            refresh_partials(spark, root)
    assert refresh_partials(spark, root) == ["2024-04", "2024-05"]
    same_reports(spark, root)


def test_stored_partials_lie_by_customer(spark, store):
    root, append = store
    append(some_events(random.Random(7), 400, 0, datetime(2024, 4, 1), 60))
    refresh_partials(spark, root)
    for name in FOLDS:
        files = list(Path(root, "_partials", name).glob("event_month=*/*.parquet"))
        assert files
        for file in files:
            customers = pq.ParquetFile(file).read(["cust_num"])["cust_num"].to_pylist()
            assert customers == sorted(customers), name


def test_ids_of_facts_are_stored_plainly(store):
    root, append = store
    append(some_events(random.Random(8), 400, 0, datetime(2024, 4, 1), 60))
    for file in Path(root, "cdr_events").glob("event_month=*/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        held = {c.path_in_schema: c.encodings for c in map(group.column, range(group.num_columns))}
        for column in ("cdr_id", "cdr_event_id"):
            assert not any("DICTIONARY" in encoding for encoding in held[column])
        assert any("DICTIONARY" in encoding for encoding in held["cust_num"])
