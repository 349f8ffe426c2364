"""One load of an extract into the store, safe to repeat."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.schemas import EVENT_MONTH, no_rows, seed_tables
from tollbook.sources import conform
from tollbook.sources.files import remove_folder, subfolders
from tollbook.sources.key_index import known_ids
from tollbook.sources.tables import append_table, load_table


# Tables that facts refer to, in the order of ``conform.judge_references``.
REFERENCES = ("customers", "objects", "offers", "operation_types")


def load_summary(attempted: dict[str, DataFrame], inserted: dict[str, DataFrame]) -> DataFrame:
    """Rows offered to each table and rows that were new, one line per table."""

    def counted(name: str) -> DataFrame:
        tried = attempted[name].agg(F.count(F.lit(1)).alias("attempted"))
        added = inserted[name].agg(F.count(F.lit(1)).alias("inserted"))
        return tried.select(
            F.lit(name).alias("table_name"), "attempted", added.scalar().alias("inserted")
        )

    lines = [counted(name) for name in inserted]
    summary = lines[0]
    for line in lines[1:]:
        summary = summary.unionByName(line)
    return summary


def rows_seen(observation: Observation) -> int:
    """The rows of a finished write.

    When Spark finds out on the way that there is nothing to write, no task runs and there are
    no metrics to convert.
    """
    try:
        return observation.get["n"]
    except Py4JJavaError as failed:
        # An observation without metrics fails to become a row; anything else is a real failure.
        if "toPyRow" in str(failed) and "assertion failed" in str(failed):
            return 0
        raise


class LoadResult(dict):
    """Rows added by table; ``refused`` counts facts without a stored reference, ``repeated``
    the complete rows whose id came before in the extract or is stored."""

    refused = 0
    repeated = 0


def load_extract(
    spark: SparkSession,
    root: str,
    raw: DataFrame,
    raw_offers: DataFrame | None = None,
    batch: str | None = None,
) -> LoadResult:
    """Conform an extract and add what is new to every table; returns rows added.

    The conformed rows are written once beside the store and every table is built from
    that copy, so the text is parsed once and lost tasks read the copy again. Dimensions go
    first, as facts refer to them. A load cut short can be repeated: stored keys are skipped.
    Rows that lack a required column are kept under ``_quarantine``, and facts whose references
    are unknown under ``_refused`` with the reasons; ``retry_refused`` takes those up again.
    ``batch`` names a load in these folders and must be its own. One load writes at a time.
    """
    batch = batch or uuid.uuid4().hex
    staged_at = os.path.join(root, "_staged", batch)
    conform.conform(raw).write.mode("overwrite").parquet(staged_at)
    staged = spark.read.parquet(staged_at)

    def stored(name: str) -> DataFrame:
        return load_table(spark, root, name)

    added = LoadResult()

    def add(name: str, rows: DataFrame) -> None:
        seen = Observation()
        append_table(rows.observe(seen, F.count(F.lit(1)).alias("n")), root, name)
        added[name] = rows_seen(seen)

    labels = seed_tables(spark)["operation_types"]
    add("customers", conform.build_customers(staged, stored("customers")))
    add("object_types", conform.build_object_types(staged, stored("object_types")))
    add(
        "operation_types",
        conform.build_operation_types(staged, stored("operation_types"), labels),
    )
    if raw_offers is not None:
        offers = conform.conform_offers(raw_offers)
        add("offers", conform.build_offers(offers, stored("offers")))
    objects = conform.build_objects(staged, stored("object_types"), stored("objects"))
    add("objects", objects.join(stored("customers"), "cust_num_bigint", "left_semi"))
    complete = conform.drop_invalid(staged)
    # The judged facts are written once, for the table and for the refused both read them.
    judged_at = os.path.join(root, "_staged", f"{batch}-facts")
    facts = conform.new_events(complete, known_ids(spark, root, complete))
    judged = conform.judge_references(facts, *[stored(name) for name in REFERENCES])
    judged.write.mode("overwrite").parquet(judged_at)
    judged = spark.read.schema(judged.schema).parquet(judged_at)
    accepted = judged.filter(F.col("refused_because").isNull())
    add("cdr_events", accepted.drop("refused_because"))
    refused = judged.filter(F.col("refused_because").isNotNull())
    refused.write.mode("overwrite").parquet(os.path.join(root, "_refused", batch))
    conform.quarantine(staged).write.mode("overwrite").parquet(
        os.path.join(root, "_quarantine", batch)
    )
    added.refused = refused.count()
    added.repeated = complete.count() - added["cdr_events"] - added.refused
    for path in (staged_at, judged_at):
        remove_folder(spark, path)
    return added


def refused_facts(spark: SparkSession, root: str) -> DataFrame:
    """The facts that loads refused and that are not stored since, once each."""
    stored = load_table(spark, root, "cdr_events")
    layout = T.StructType(
        [field for field in stored.schema if field.name != EVENT_MONTH]
    ).add("refused_because", "string")
    folders = subfolders(spark, os.path.join(root, "_refused"))
    if not folders:
        return no_rows(spark, layout)
    kept = spark.read.schema(layout).parquet(*(os.path.join(root, "_refused", name) for name in folders))
    once = kept.dropDuplicates(["cdr_id"])
    known = known_ids(spark, root, once)
    return once if known is None else once.join(known, "cdr_id", "left_anti")


def retry_refused(spark: SparkSession, root: str) -> int:
    """Add refused facts whose references have arrived since; returns how many.

    What still waits replaces the folders of all loads so far, so that they do not pile up.
    """
    old = subfolders(spark, os.path.join(root, "_refused"))
    known = [load_table(spark, root, name) for name in REFERENCES]
    kept_at = os.path.join(root, "_refused", f"kept-{uuid.uuid4().hex}")
    judged = conform.judge_references(refused_facts(spark, root).drop("refused_because"), *known)
    staged_at = os.path.join(root, "_staged", uuid.uuid4().hex)
    judged.write.parquet(staged_at)
    judged = spark.read.schema(judged.schema).parquet(staged_at)
    seen = Observation()
    facts = judged.filter(F.col("refused_because").isNull()).drop("refused_because")
    append_table(facts.observe(seen, F.count(F.lit(1)).alias("n")), root, "cdr_events")
    judged.filter(F.col("refused_because").isNotNull()).write.parquet(kept_at)
    for name in old:
        remove_folder(spark, os.path.join(root, "_refused", name))
    remove_folder(spark, staged_at)
    return rows_seen(seen)
