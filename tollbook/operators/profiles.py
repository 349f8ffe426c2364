"""Lookups of single customers or objects, and the same for all of them at once."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.functions.ranking import top_rows_per_key
from tollbook.sources.tables import Tables

RECENT_EVENTS = 100

EVENT_COLUMNS = (
    "cdr_event_id",
    "creation_time",
    "operation_type",
    "offer_name",
    "deduct_amount",
    "charge_amount",
    "current_amount_pre",
    "current_amount_post",
)
AMOUNTS = EVENT_COLUMNS[4:]


def _only(frame: DataFrame, column: str, ids: Iterable[int] | None) -> DataFrame:
    return frame if ids is None else frame.filter(F.col(column).isin(list(ids)))


def _recent_events(
    tables: Tables, key: str, ids: Iterable[int] | None, limit: int
) -> DataFrame:
    """The latest events per key; the order is total, so a repeat gives the same rows."""
    operations = tables["operation_types"].withColumnRenamed("description", "operation_type")
    described = (
        _only(tables["cdr_events"], key, ids)
        .join(operations, "operation_type_id")
        .join(tables["offers"], "offer_id", "left")
        .select(key, *EVENT_COLUMNS)
    )
    order = [F.desc("creation_time"), *[F.asc_nulls_first(c) for c in EVENT_COLUMNS if c != "creation_time"]]
    latest = top_rows_per_key(described, [key], order, limit, "event_no")
    return latest.withColumns({name: F.col(name).cast("double") for name in AMOUNTS})


def customer_objects(
    tables: Tables, as_of: datetime | None = None, customers: Iterable[int] | None = None
) -> DataFrame:
    """Objects of the given (or all) customers, latest expiry first."""
    return (
        _only(tables["objects"], "cust_num_bigint", customers)
        .join(tables["object_types"], "object_type_id")
        .select(
            F.col("cust_num_bigint").alias("cust_num"),
            F.col("object_id_bigint").alias("object_id"),
            F.col("description").alias("object_type_description"),
            "expiry_date",
        )
        .orderBy("cust_num", F.desc("expiry_date"), "object_id")
    )


def customer_recent_events(
    tables: Tables,
    as_of: datetime | None = None,
    customers: Iterable[int] | None = None,
    limit: int = RECENT_EVENTS,
) -> DataFrame:
    """The latest events of the given (or all) customers, numbered from the latest."""
    recent = _recent_events(tables, "cust_num", customers, limit)
    return recent.withColumn("event_no", F.col("event_no").cast("bigint"))


def customer_profile(
    tables: Tables,
    as_of: datetime | None = None,
    customers: Iterable[int] | None = None,
    limit: int = RECENT_EVENTS,
) -> DataFrame:
    """Master row, objects and latest events of the given (or all) customers.

    One row per item, told apart by ``section``: a customer may own any number of objects,
    so they are not gathered into one value. Customers not in the master have no profile.
    """
    master = _only(tables["customers"], "cust_num_bigint", customers).select(
        F.col("cust_num_bigint").alias("cust_num"), "cust_type"
    )
    objects = _only(tables["objects"], "cust_num_bigint", customers).join(
        tables["object_types"], "object_type_id"
    )
    sections = [
        master.select("cust_num", F.lit("customer_info").alias("section")),
        objects.select(
            F.col("cust_num_bigint").alias("cust_num"),
            F.lit("objects").alias("section"),
            F.col("object_id_bigint").alias("object_id"),
            F.col("description").alias("object_type_description"),
            "expiry_date",
        ),
        _recent_events(tables, "cust_num", customers, limit)
        .withColumn("section", F.lit("cdr_events"))
        .drop("event_no"),
    ]
    items = sections[0]
    for section in sections[1:]:
        items = items.unionByName(section, allowMissingColumns=True)
    return items.join(master, "cust_num").select(
        "cust_num", "cust_type", "section", "object_id", "object_type_description", "expiry_date",
        *EVENT_COLUMNS,
    )


def object_profile(
    tables: Tables,
    as_of: datetime | None = None,
    objects: Iterable[int] | None = None,
    limit: int = RECENT_EVENTS,
) -> DataFrame:
    """Object row beside each of its latest events; objects without events keep one row."""
    described = (
        _only(tables["objects"], "object_id_bigint", objects)
        .join(tables["object_types"], "object_type_id")
        .select(
            F.col("object_id_bigint").alias("object_id"),
            F.col("cust_num_bigint").alias("cust_num"),
            F.col("description").alias("object_type_description"),
            "expiry_date",
        )
    )
    events = _recent_events(tables, "object_id", objects, limit).drop("event_no")
    return described.join(events, "object_id", "left")
