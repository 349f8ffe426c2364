"""Conforming faulty extracts, and loads that can be repeated."""

from __future__ import annotations

import os
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from star_rows import event, rows_of
from tollbook.schemas import seed_tables
from tollbook.sources import conform
from tollbook.sources.load import load_extract, refused_facts, retry_refused
from tollbook.sources.raw import FACT_HEADERS as HEADERS
from tollbook.sources.raw import read_raw
from tollbook.sources.tables import (
    append_table,
    create_store,
    load_table,
    load_tables,
    reset_facts,
)

GOOD = [
    "1", "20240101120000", "100", "S", "1000", "F", "1", "1482110", "1.50", "0", "5", "3.50",
    None, "20240201000000",
]


@pytest.fixture
def raw(spark):
    def build(*changes: dict):
        rows = [tuple({**dict(zip(HEADERS, GOOD)), **change}.values()) for change in changes]
        return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in HEADERS))

    return build


def only(frame):
    found = rows_of(frame)
    assert len(found) == 1
    return found[0]


def test_good_row(raw):
    row = only(conform.conform(raw({})))
    assert row["creation_time"] == datetime(2024, 1, 1, 12)
    assert row["current_amount_expire_time"] == datetime(2024, 2, 1)
    assert (row["cust_num"], row["offer_id"], row["operation_type_id"]) == (100, 1482110, 1)
    assert (row["current_amount_pre"], row["current_amount_post"]) == (Decimal("5"), Decimal("3.5"))
    assert row["charge_expire_time"] is None


@pytest.mark.parametrize(
    ("text", "time"),
    [
        ("20240101120000.0", datetime(2024, 1, 1, 12)),
        (" 20240101120000 ", datetime(2024, 1, 1, 12)),
        ("2024-01-01 12:00:00", datetime(2024, 1, 1, 12)),
        ("2024-01-01T12:00:00.5", datetime(2024, 1, 1, 12, 0, 0, 500000)),
        ("20241301120000", None),
        ("20240230120000", None),
        ("20240101126000", None),
        ("20240101120000.7", None),
        ("2024010112", None),
        ("soon", None),
        ("", None),
    ],
)
def test_times(spark, text, time):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(conform.wall_clock(F.col("t")).alias("t")).first()["t"] == time


@pytest.mark.parametrize(
    ("text", "number"),
    [("12", 12), ("12.0", 12), (" 12 ", 12), ("12.5", None), ("x", None), ("", None), ("-3", -3),
     ("99999999999999999999999", None)],
)
def test_identifiers(spark, text, number):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(conform.whole_number(F.col("t")).alias("n")).first()["n"] == number


def test_text_ids_survive_and_blank_ids_do_not(raw):
    conformed = conform.conform(raw({"CDR_ID": "CDR-7"}, {"CDR_ID": "  "}, {"CDR_ID": None}))
    assert only(conform.drop_invalid(conformed))["cdr_id"] == "CDR-7"
    rejected = rows_of(conform.quarantine(conformed))
    assert [r["missing_columns"] for r in rejected] == ["cdr_id", "cdr_id"]


def test_unreadable_amounts_are_zero(raw):
    row = only(conform.conform(raw({"DEDUCT_AMOUNT": "n/a", "CHARGE_AMOUNT": None})))
    assert row["deduct_amount"] == 0 and row["charge_amount"] == 0


def test_missing_columns_are_left_out(raw):
    conformed = conform.conform(raw({}).drop("OFFER_ID", "CURENT_AMOUNT.2").withColumn("OTHER", F.lit(1)))
    columns = conform.project_known(conformed, conform.FACT_COLUMNS).columns
    assert "offer_id" not in columns and "other" not in columns and columns[0] == "cdr_id"


def test_first_customer_type_wins(raw):
    conformed = conform.conform(
        raw(
            {"CUST_TYPE": "A", "CREATION_TIME": "20240103000000"},
            {"CUST_TYPE": "S", "CREATION_TIME": "20240102000000"},
            {"CUST_TYPE": "Q", "CREATION_TIME": "20240101000000"},
            {"CUST_TYPE": "A", "CREATION_TIME": "never"},
            {"CUST_NUM": "200", "CUST_TYPE": None},
        )
    )
    assert only(conform.build_customers(conformed)) == {"cust_num_bigint": 100, "cust_type": "S"}


def test_type_codes_are_one_in_both_cases(spark, raw):
    conformed = conform.conform(
        raw({"OBJECT_type": "c"}, {"OBJECT_type": "C"}, {"OBJECT_type": "z"}, {"OBJECT_type": "y"},
            {"OBJECT_type": "long"}, {"OBJECT_type": None})
    )
    fresh = conform.build_object_types(conformed, seed_tables(spark)["object_types"])
    assert [(r["object_type_id"], r["object_type_code"]) for r in rows_of(fresh)] == [(4, "Y"), (5, "Z")]


def test_object_of_two_expiries(spark, raw):
    conformed = conform.conform(
        raw(
            {"CURENT_AMOUNT_EXPIRE_TIME": None},
            {"CURENT_AMOUNT_EXPIRE_TIME": "20240301000000"},
            {"CURENT_AMOUNT_EXPIRE_TIME": "20240215000000", "OBJECT_type": "C"},
            {"CURENT_AMOUNT_EXPIRE_TIME": "20240215000000", "OBJECT_type": "B"},
            {"OBJECT_ID": "7", "OBJECT_type": "?"},
        )
    )
    row = only(conform.build_objects(conformed, seed_tables(spark)["object_types"]))
    assert (row["expiry_date"], row["object_type_id"]) == (datetime(2024, 2, 15), 2)


def test_stored_operation_labels_stay(spark, raw):
    conformed = conform.conform(raw(*[{"OPERATION_TYPE": str(n)} for n in (0, 4, 5, 6)]))
    labels = seed_tables(spark)["operation_types"]
    assert conform.build_operation_types(conformed, labels, labels).count() == 0
    fresh = conform.build_operation_types(conformed, labels.filter("operation_type_id < 5"), labels)
    assert only(fresh)["description"] == "Add to existing Free Resource"


def store(spark, folder):
    create_store(spark, folder)
    return folder


def test_repeated_load_adds_nothing(spark, raw, tmp_path):
    root = store(spark, str(tmp_path / "s"))
    offers = spark.createDataFrame(
        [("5", "New Data"), ("5", "Again"), ("x", "Bad")],
        "`OFfERID` string, `Nom de l'offre` string",
    )
    extract = raw(
        {}, {}, {"CDR_ID": "2", "OFFER_ID": "5"}, {"CDR_ID": "3", "OFFER_ID": None},
        {"CDR_ID": "4", "OFFER_ID": "404"}, {"CDR_ID": "5", "OPERATION_TYPE": "6"},
        {"CDR_ID": "6", "OBJECT_type": None, "OBJECT_ID": "1001"}, {"CDR_ID": None},
        {"CDR_ID": "7", "CREATION_TIME": "20240205000000"},
    )
    first = load_extract(spark, root, extract, offers)
    assert first == {
        "customers": 1,
        "object_types": 0,
        "operation_types": 0,
        "offers": 1,
        "objects": 1,
        "cdr_events": 4,
    }
    again = load_extract(spark, root, extract, offers)
    assert set(again.values()) == {0}
    facts = load_table(spark, root, "cdr_events")
    assert sorted(r["cdr_id"] for r in facts.collect()) == ["1", "2", "3", "7"]
    assert {r["event_month"] for r in facts.collect()} == {"2024-01", "2024-02"}
    more = load_extract(spark, root, raw({}, {"CDR_ID": "8"}))
    assert more["cdr_events"] == 1
    assert only(load_table(spark, root, "offers").filter("offer_id = 5"))["offer_name"] == "Again"
    assert spark.read.parquet(os.path.join(root, "_quarantine", "*")).count() == 2


def test_refused_facts_are_kept_and_retried(spark, raw, tmp_path):
    root = store(spark, str(tmp_path / "s"))
    extract = raw(
        {}, {}, {"CDR_ID": "2", "OFFER_ID": "404"}, {"CDR_ID": "3", "OPERATION_TYPE": "6"},
        {"CDR_ID": "4", "CUST_NUM": "9", "CUST_TYPE": "Q", "OBJECT_ID": None}, {"CREATION_TIME": None},
    )
    result = load_extract(spark, root, extract)
    assert (result["cdr_events"], result.refused, result.repeated) == (1, 3, 1)
    reasons = {r["cdr_id"]: r["refused_because"] for r in refused_facts(spark, root).collect()}
    assert reasons == {
        "2": "unknown offer", "3": "unknown operation", "4": "unknown customer, unknown object",
    }
    assert retry_refused(spark, root) == 0
    offers = spark.createDataFrame([("404", "New")], "`OFfERID` string, `Nom de l'offre` string")
    load_extract(spark, root, raw({}), offers)
    assert retry_refused(spark, root) == 1 and retry_refused(spark, root) == 0
    assert sorted(r["cdr_id"] for r in load_table(spark, root, "cdr_events").collect()) == ["1", "2"]
    assert refused_facts(spark, root).count() == 2
    assert not list((tmp_path / "s" / "_staged").glob("*"))


def test_a_load_leaves_few_files(spark, star, tmp_path):
    root = store(spark, str(tmp_path / "s"))
    events = [event(i, i % 9, datetime(2024, 1 + i % 3, 1 + i % 28)) for i in range(900)]
    append_table(star(events)["cdr_events"].repartition(16), root, "cdr_events")
    months = sorted((tmp_path / "s" / "cdr_events").glob("event_month=*"))
    assert [m.name[-7:] for m in months] == ["2024-01", "2024-02", "2024-03"]
    assert all(len(list(m.glob("*.parquet"))) == 1 for m in months)


def test_earliest_record_of_an_id_wins(spark, raw):
    valid = conform.drop_invalid(
        conform.conform(raw({"CREATION_TIME": "20240105000000"}, {"CREATION_TIME": "20240102000000"}))
    )
    assert only(conform.new_events(valid))["creation_time"] == datetime(2024, 1, 2)


def test_reset_empties_facts_only(spark, raw, tmp_path):
    root = store(spark, str(tmp_path / "s"))
    load_extract(spark, root, raw({}))
    reset_facts(spark, root)
    assert load_table(spark, root, "cdr_events").count() == 0
    assert load_table(spark, root, "customers").count() == 1
    assert load_extract(spark, root, raw({}))["cdr_events"] == 1


def test_reports_read_the_store(spark, raw, tmp_path):
    from tollbook.operators.revenue import arpu

    root = store(spark, str(tmp_path / "s"))
    load_extract(spark, root, raw({}, {"CDR_ID": "2", "CREATION_TIME": "20220101000000"}))
    row = only(arpu(load_tables(spark, root), datetime(2024, 3, 31)))
    assert (row["month"], row["total_revenue"]) == ("2024-01", 1.5)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_raw_formats(spark, raw, tmp_path, fmt):
    path = str(tmp_path / fmt)
    extract = raw({}, {"CDR_ID": "00012"})
    if fmt in ("parquet", "orc"):
        extract = extract.withColumn("DEDUCT_AMOUNT", F.col("DEDUCT_AMOUNT").cast("double"))
    writer = extract.write.option("header", True)
    writer.format(fmt).save(path)
    back = read_raw(spark, path, fmt)
    assert {t for _, t in back.dtypes} == {"string"}
    conformed = conform.conform(back)
    assert {r["cdr_id"] for r in rows_of(conformed)} == {"1", "00012"}
    assert {r["deduct_amount"] for r in rows_of(conformed)} == {Decimal("1.50")}


def test_named_json_columns(spark, raw, tmp_path):
    path = str(tmp_path / "json")
    raw({"OFFER_ID": None}).write.json(path)
    back = read_raw(spark, path, "json", columns=HEADERS)
    assert back.columns == list(HEADERS) and only(back)["OFFER_ID"] is None


def test_unknown_raw_format(spark):
    with pytest.raises(ValueError, match="xlsx"):
        read_raw(spark, "x", "xlsx")
