"""Streams over several files against the batch results."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from star_rows import NOW, event, rows_of
from tollbook.operators.monitoring import activity_snapshot
from tollbook.schemas import CDR_EVENTS
from tollbook.sources.raw import FACT_HEADERS
from tollbook.sources.tables import create_store, load_table
from tollbook.streaming.activity import activity_stream, activity_windows, append_to_files, customer_stream, open_activity, publish_open
from tollbook.streaming.freshness import freshness_stream, latest_health
from tollbook.streaming.ingest import ingest_stream

START = datetime(2024, 3, 1)


def write_files(spark, folder, batches):
    """One file per batch, each written later than the one before."""
    for number, events in enumerate(batches):
        frame = spark.createDataFrame([tuple(e[n] for n in CDR_EVENTS.names) for e in events], CDR_EVENTS)
        frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CDR_EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def hourly(minutes, first=0):
    return [
        event(first + i, i % 3, START + timedelta(minutes=m), deduct_amount=i)
        for i, m in enumerate(minutes)
    ]


def test_closed_windows_equal_the_batch(spark, tmp_path):
    events = hourly(range(0, 300, 7))
    stream = write_files(spark, str(tmp_path / "in"), [events[:20], events[20:]])
    out = str(tmp_path / "out")
    append_to_files(activity_stream(stream, "1 hour", "1 hour"), out, str(tmp_path / "c"))
    got = {r["window_start"]: r for r in spark.read.parquet(out).collect()}
    newest = max(e["creation_time"] for e in events)
    expected = {}
    for e in events:
        hour = e["creation_time"].replace(minute=0)
        if hour + timedelta(hours=1) <= newest - timedelta(hours=1):
            expected.setdefault(hour, []).append(e)
    assert set(got) == set(expected)
    for hour, own in expected.items():
        assert got[hour]["event_count"] == len(own)
        assert got[hour]["active_users"] == len({e["cust_num"] for e in own})
        assert got[hour]["total_revenue"] == float(sum(e["deduct_amount"] for e in own))


def test_facts_within_the_delay_are_counted(spark, tmp_path):
    on_time = hourly([10, 20, 100])
    late = hourly([50], first=100)
    closing = hourly([600], first=200)
    stream = write_files(spark, str(tmp_path / "in"), [on_time, late, closing])
    out = str(tmp_path / "out")
    append_to_files(activity_stream(stream, "1 hour", "1 hour"), out, str(tmp_path / "c"))
    got = {r["window_start"]: r["event_count"] for r in spark.read.parquet(out).collect()}
    assert got == {START: 3, START + timedelta(hours=1): 1}


def test_session_must_be_utc(spark, star):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="UTC"):
            activity_stream(star()["cdr_events"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_freshness_follows_the_newest_fact(spark, tmp_path):
    stream = write_files(
        spark,
        str(tmp_path / "in"),
        [
            [event(1, 1, NOW - timedelta(minutes=90))],
            [event(2, 1, NOW - timedelta(minutes=61))],
        ],
    )
    out = str(tmp_path / "out")
    freshness_stream(stream, NOW, out, str(tmp_path / "c")).awaitTermination()
    row = rows_of(latest_health(spark, out))[0]
    assert (row["minutes_since_last_record"], row["total_records"]) == (61, 2)
    assert row["health_status"].startswith("Warning")


def test_stream_ingest_skips_what_is_stored(spark, tmp_path):
    def drop_file(ids, name):
        lines = [",".join(FACT_HEADERS)]
        lines += [f"{i},20240101120000,100,S,1000,F,1,,1.5,0,5,3.5,,20240201000000" for i in ids]
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(lines) + "\n")

    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "c")
    create_store(spark, root)
    schema = ", ".join(f"`{h}` string" for h in FACT_HEADERS)

    def run():
        raw = spark.readStream.schema(schema).option("header", True).csv(str(tmp_path / "in"))
        ingest_stream(raw, root, checkpoint).awaitTermination()
        return sorted(r["cdr_id"] for r in load_table(spark, root, "cdr_events").collect())

    drop_file(["1", "2", "2"], "a.csv")
    assert run() == ["1", "2"]
    drop_file(["2", "3"], "b.csv")
    assert run() == ["1", "2", "3"]
    first = spark.read.parquet(os.path.join(root, "_quarantine", "*")).count()
    assert first == 0
    # A lost checkpoint replays everything; the store stays as it is.
    checkpoint = str(tmp_path / "c2")
    assert run() == ["1", "2", "3"]
    assert os.path.isdir(os.path.join(root, "_staged"))


def test_two_streams_keep_both_bad_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    schema = ", ".join(f"`{h}` string" for h in FACT_HEADERS)
    for name in ("a", "b"):
        folder = tmp_path / name
        folder.mkdir()
        lines = [",".join(FACT_HEADERS), f"{name},never,100,S,1000,F,1,,1.5,0,5,3.5,,20240201000000"]
        (folder / "x.csv").write_text("\n".join(lines) + "\n")
        raw = spark.readStream.schema(schema).option("header", True).csv(str(folder))
        ingest_stream(raw, root, str(tmp_path / f"c-{name}")).awaitTermination()
    kept = spark.read.parquet(os.path.join(root, "_quarantine", "*")).collect()
    assert sorted(r["cdr_id"] for r in kept) == ["a", "b"]


def test_late_facts_are_counted_and_restated(spark, tmp_path):
    batches = [hourly([10, 200]), hourly([600], first=100), hourly([20], first=200), hourly([900], first=300)]
    stream = write_files(spark, str(tmp_path / "in"), batches)
    out = str(tmp_path / "out")
    late = append_to_files(activity_stream(stream, "1 hour", "1 hour"), out, str(tmp_path / "c"))
    assert late == 1
    published = {r["window_start"]: r["event_count"] for r in spark.read.parquet(out).collect()}
    restated = {r["window_start"]: r["event_count"] for r in activity_windows(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert published[START] == 1 and restated[START] == 2


def test_health_after_a_restart(spark, tmp_path):
    out = str(tmp_path / "out")
    old = write_files(spark, str(tmp_path / "in"), [[event(1, 1, NOW - timedelta(minutes=90))], [event(2, 1, NOW - timedelta(minutes=80))]])
    freshness_stream(old, NOW, out, str(tmp_path / "c1")).awaitTermination()
    new = write_files(spark, str(tmp_path / "in2"), [[event(3, 1, NOW - timedelta(minutes=5))]])
    freshness_stream(new, NOW, out, str(tmp_path / "c2")).awaitTermination()
    assert rows_of(latest_health(spark, out))[0]["minutes_since_last_record"] == 5


def test_open_windows_are_published_after_every_trigger(spark, star, tmp_path):
    """Every trigger brings one file; the published hour equals the report over the same facts."""
    now = START + timedelta(hours=2, minutes=59)
    batches = [hourly([5, 130, 140]), hourly([150, 121, 100], first=10), hourly([170, 171, 175], first=20)]
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "c"))
    seen = []
    for events in batches:
        stream = write_files(spark, folder, [events])
        publish_open(customer_stream(stream, "1 hour", "1 hour"), out, checkpoint).awaitTermination()
        seen += events
        tables = star(seen)
        hour = next(r for r in rows_of(activity_snapshot(tables, now + timedelta(minutes=1))) if r["metric_type"] == "current_hour")
        windows = {r["window_start"]: r for r in rows_of(open_activity(spark, out))}
        got = windows[START + timedelta(hours=2)]
        for column in ("event_count", "active_users", "total_revenue", "avg_transaction_value"):
            assert got[column] == hour[column], column
        assert windows[START]["event_count"] == 1
        assert len(windows) == len({e["creation_time"].hour for e in seen})


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "c"))
    stream = write_files(spark, folder, [hourly([5, 130, 140]), hourly([150, 121], first=10)])
    publish_open(customer_stream(stream), out, checkpoint).awaitTermination()
    before = sorted(map(str, rows_of(open_activity(spark, out))))
    # The last batch did not get as far as being marked as done.
    newest = max((name for name in os.listdir(os.path.join(checkpoint, "commits")) if name.isdigit()), key=int)
    for name in (newest, f".{newest}.crc"):
        os.remove(os.path.join(checkpoint, "commits", name))
    again = spark.readStream.schema(CDR_EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    publish_open(customer_stream(again), out, checkpoint).awaitTermination()
    assert sorted(map(str, rows_of(open_activity(spark, out)))) == before


def test_late_rows_of_long_runs_are_all_counted(spark, tmp_path):
    """A query remembers its last reports only; the count does not depend on them."""
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        batches = [hourly([600]), hourly([601], first=9_200), *(hourly([m], first=100 * m) for m in (10, 20, 30, 40)), hourly([900], first=9_000), hourly([901], first=9_100)]
        stream = write_files(spark, str(tmp_path / "in"), batches)
        assert append_to_files(activity_stream(stream), str(tmp_path / "out"), str(tmp_path / "c")) == 4
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
