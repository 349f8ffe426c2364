from __future__ import annotations

import math
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tollbook.functions import calendar, categories, measures, ranking
from tollbook.schemas import SEED_OFFERS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("start", "end", "hours", "minutes"),
    [
        ("2024-01-01 00:00:00", "2024-01-02 01:59:59", 25, 1559),
        ("2024-01-01 00:30:00", "2024-01-01 00:00:00", 0, -30),
        ("2024-01-02 01:30:00", "2024-01-01 00:00:00", -25, -1530),
        # A clock change in many zones: wall-clock time does not know it.
        ("2024-03-31 00:00:00", "2024-03-31 06:00:00", 6, 360),
    ],
)
def test_complete_units_toward_zero(spark, start, end, hours, minutes):
    assert one(spark, calendar.hours_between(at(start), at(end))) == hours
    assert one(spark, calendar.minutes_between(at(start), at(end))) == minutes


def test_other_session_zone_changes_nothing(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        gap = calendar.hours_between(at("2024-03-31 00:00:00"), at("2024-03-31 06:00:00"))
        assert one(spark, gap) == 6
        assert one(spark, calendar.month_of(at("2024-03-31 02:30:00"))) == "2024-03"
        assert one(spark, calendar.month_start(at("2024-03-31 02:30:00"))) == date(2024, 3, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_month_ends_are_clamped(spark):
    as_of = datetime(2024, 8, 31, 10)
    assert one(spark, calendar.shifted(as_of, -6, "MONTH")) == datetime(2024, 2, 29, 10)
    assert one(spark, calendar.shifted(datetime(2024, 2, 29), -1, "YEAR")) == datetime(2023, 2, 28)


def test_days_between_uses_dates_only(spark):
    gap = calendar.days_between(at("2024-01-02 00:01:00"), at("2024-01-01 23:59:00"))
    assert one(spark, gap) == 1


def test_matching_ignores_case(spark):
    assert one(spark, categories.mentions(F.lit("Loan_3Min_6SMS_5xx"), ("min",)))
    assert one(spark, categories.mentions(F.lit(None).cast("string"), ("min",))) is None


def test_seed_catalogue_has_no_reachable_loan_category(spark):
    frame = spark.createDataFrame(SEED_OFFERS, "offer_id int, offer_name string")
    label = categories.category(F.col("offer_name"), categories.PREFERENCE_RULES)
    counts = {r["k"]: r["count"] for r in frame.groupBy(label.alias("k")).count().collect()}
    assert counts == {"Data Users": 13, "Voice-centric users": 1, "General users": 1}
    assert (
        one(spark, categories.category(F.lit("Loan_Cash"), categories.PREFERENCE_RULES))
        == "Loan takers"
    )


def test_ratios_and_sums_of_nothing(spark):
    assert one(spark, measures.safe_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, measures.ratio_or_zero(F.lit(1), F.lit(0))) == 0.0
    empty = spark.range(0).select(F.col("id").cast("decimal(15,2)").alias("a"))
    got = empty.agg(
        measures.total(F.col("a")).alias("t"),
        measures.total_or_zero(F.col("a")).alias("z"),
        measures.mean(F.col("a")).alias("m"),
    ).first()
    assert (got["t"], got["z"], got["m"]) == (None, 0.0, None)


def nearest(values, share):
    ordered = sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
    return ordered[math.ceil(share * len(ordered)) - 1]


@pytest.mark.parametrize("seed", range(4))
def test_nearest_rank_against_sorting(spark, seed):
    dice = random.Random(seed)
    pools = [
        [Decimal(dice.randrange(-500, 500)) / 100 for _ in range(400)],
        # One value in a third of the rows, and amounts over twelve orders of magnitude.
        [Decimal("7.77")] * 200 + [Decimal(dice.randrange(10 ** dice.randrange(1, 13))) / 100 for _ in range(400)],
        [None] * 300 + [Decimal(dice.randrange(1000)) for _ in range(100)],
        [Decimal("1.00")],
    ]
    for values in pools:
        frame = spark.createDataFrame([(v,) for v in values], "a decimal(25,2)")
        cut = ranking.nearest_rank(frame, "a", {"hi": Decimal("0.8"), "lo": Decimal("0.5")})
        got = spark.range(1).select(cut.alias("cut")).first()["cut"]
        assert got["hi"] == nearest(values, Decimal("0.8"))
        assert got["lo"] == nearest(values, Decimal("0.5"))


def test_nearest_rank_of_nothing(spark):
    frame = spark.createDataFrame([], "a decimal(25,2)")
    cut = ranking.nearest_rank(frame, "a", {"hi": Decimal("0.8")})
    assert spark.range(1).select(cut.alias("cut")).first()["cut"]["hi"] is None


def test_top_rows_with_a_hot_key(spark):
    frame = spark.range(20000).selectExpr(
        "IF(id % 3 = 0, 0, id % 50) AS k", "(id * 7919) % 20000 AS v"
    )
    top = ranking.top_rows_per_key(frame, ["k"], [F.desc("v")], 5, "n").collect()
    expected = {}
    for row in frame.collect():
        expected.setdefault(row["k"], []).append(row["v"])
    got = {}
    for row in sorted(top, key=lambda r: (r["k"], r["n"])):
        got.setdefault(row["k"], []).append(row["v"])
    assert got == {k: sorted(v, reverse=True)[:5] for k, v in expected.items()}
