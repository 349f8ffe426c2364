"""The id index: it follows the fact table, and a small load opens few of its files."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import functions as F

from star_rows import event
from tollbook.sources import conform
from tollbook.sources.key_index import BUCKETS, bucket_of, catch_up, known_ids
from tollbook.sources.tables import append_table, create_store, load_table, reset_facts


def facts(star, ids, month=1):
    return star([event(n, 1, datetime(2023, month, 5)) for n in ids])["cdr_events"]


def batch(spark, ids):
    return spark.createDataFrame([(str(n),) for n in ids], "cdr_id string")


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def buckets_read(frame):
    """The folders that the scan is limited to."""
    one, several = re.search(r"bucket#\d+ = (\d+)", plan_of(frame)), re.search(r"bucket#\d+ (?:IN|INSET) \(?([\d, ]+)", plan_of(frame))
    return {one[1]} if one else set(several[1].replace(" ", "").split(","))


def ids_of(frame):
    return {int(r["cdr_id"]) for r in frame.collect()}


def test_a_small_batch_reads_few_files(spark, star, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    for month in range(1, 13):
        append_table(facts(star, range(month * 1_000, month * 1_000 + 400), month), root, "cdr_events")
    found = known_ids(spark, root, batch(spark, [1_001, 7_300, 99_999]))
    every = known_ids(spark, root, batch(spark, range(1_000, 13_000)))
    assert {1_001, 7_300} <= ids_of(found) and 99_999 not in ids_of(found)
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert len(buckets_read(found)) <= 3 < BUCKETS / 2 < every.select(bucket_of(F.col("cdr_id"))).distinct().count()
    assert len(ids_of(every)) == 12 * 400
    # The whole fact table gives the same verdict.
    new = facts(star, [1_001, 7_300, 99_999])
    by_index, by_facts = (conform.new_events(new, known) for known in (known_ids(spark, root, new), load_table(spark, root, "cdr_events")))
    assert ids_of(by_index) == ids_of(by_facts) == {99_999}


def test_it_follows_appends_and_resets(spark, star, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    assert known_ids(spark, root, batch(spark, [1])) is None or not ids_of(known_ids(spark, root, batch(spark, [1])))
    append_table(facts(star, [1, 2]), root, "cdr_events")
    assert ids_of(known_ids(spark, root, batch(spark, [1, 2, 3]))) == {1, 2}
    assert catch_up(spark, root) == 0
    append_table(facts(star, [3], month=2), root, "cdr_events")
    assert ids_of(known_ids(spark, root, batch(spark, [1, 2, 3]))) == {1, 2, 3}
    reset_facts(spark, root)
    append_table(facts(star, [2]), root, "cdr_events")
    assert ids_of(known_ids(spark, root, batch(spark, [1, 2, 3]))) == {2}
