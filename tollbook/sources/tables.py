"""The stored star schema: one Parquet folder per table."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollbook.functions.calendar import month_of
from tollbook.schemas import EVENT_MONTH, LAYOUTS, no_rows, seed_tables

Tables = Mapping[str, DataFrame]


def table_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared layout; nothing is inferred from the files."""
    return spark.read.schema(LAYOUTS[name]).parquet(table_path(root, name))


def load_tables(spark: SparkSession, root: str) -> Tables:
    return {name: load_table(spark, root, name) for name in LAYOUTS}


def load_jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    split_column: str,
    lower: int,
    upper: int,
    parts: int,
    **options: str,
) -> DataFrame:
    """A table of a relational database, read in ``parts`` key ranges at once."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, **options)
        .options(
            partitionColumn=split_column, lowerBound=lower, upperBound=upper, numPartitions=parts
        )
        .load()
    )


def append_table(frame: DataFrame, root: str, name: str) -> None:
    """Add rows to a stored table; facts go to the folder of their month.

    Facts are gathered by month first, so a load leaves few files per month and not one per
    task and month; the rebalance splits a month that is too large for one task. Sorting by
    customer gives the files narrow customer ranges for scans to skip by. Ids no two facts share
    are stored plainly, without trying a dictionary first.
    """
    columns = [field.name for field in LAYOUTS[name].fields]
    if name == "cdr_events":
        stored = frame.withColumn(EVENT_MONTH, month_of(F.col("creation_time"))).select(columns)
        gathered = stored.hint("rebalance", F.col(EVENT_MONTH))
        ordered = gathered.sortWithinPartitions(EVENT_MONTH, "cust_num")
        writer = ordered.write.partitionBy(EVENT_MONTH)
        for column in ("cdr_event_id", "cdr_id"):
            writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    else:
        writer = frame.select(columns).write
    writer.mode("append").parquet(table_path(root, name))


def reset_facts(spark: SparkSession, root: str) -> None:
    """Empty the fact table and leave the dimensions alone."""
    _write_empty(spark, root, "cdr_events")


def create_store(spark: SparkSession, root: str) -> None:
    """A new store: seeded lookups, and customers, objects and facts without rows."""
    for name, rows in seed_tables(spark).items():
        rows.coalesce(1).write.mode("errorifexists").parquet(table_path(root, name))
    for name in ("customers", "objects", "cdr_events"):
        _write_empty(spark, root, name)


def _write_empty(spark: SparkSession, root: str, name: str) -> None:
    writer = no_rows(spark, LAYOUTS[name]).write.mode("overwrite")
    if name == "cdr_events":
        writer = writer.option("partitionOverwriteMode", "static").partitionBy(EVENT_MONTH)
    writer.parquet(table_path(root, name))
