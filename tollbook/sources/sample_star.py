"""The star schema and raw extracts derived from the generated sample tables.

Two profiles fill the fact table: ``events`` (one fact per row of ``events``, for hours,
days and expiry) and ``lineitem`` (one fact per line item and its order, for months,
customers and offers). Orphans, NULLs and lookup rows without facts are part of both.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.schemas import (
    CDR_EVENTS,
    OBJECT_TYPES,
    OBJECTS,
    OFFERS,
    OPERATION_TYPES,
    SEED_OBJECT_TYPES,
    SEED_OFFERS,
    SEED_OPERATION_TYPES,
    literal_rows,
)
from tollbook.sources.tables import Tables

EVENTS_AS_OF = datetime(2024, 1, 30, 23, 30)
LINEITEM_AS_OF = datetime(2001, 7, 1)

# The columns read from the sample tables. Naming them saves a look into the files.
SAMPLE_COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string",
}


def sample(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.schema(SAMPLE_COLUMNS[name]).parquet(path)


class SampleTables(Mapping):
    """Tables that are put together when they are asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _lookups(spark: SparkSession) -> dict[str, Callable[[], DataFrame]]:
    types = SEED_OBJECT_TYPES + [(4, "X", "Unused")]
    operations = SEED_OPERATION_TYPES + [(9, "Unused")]
    return {
        "offers": lambda: literal_rows(spark, SEED_OFFERS, OFFERS),
        "object_types": lambda: literal_rows(spark, types, OBJECT_TYPES),
        "operation_types": lambda: literal_rows(spark, operations, OPERATION_TYPES),
    }


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        sample(spark, sf_dir, "customer")
        .filter("c_custkey % 50 <> 7")
        .selectExpr(
            "c_custkey AS cust_num_bigint",
            "IF(c_mktsegment IN ('BUILDING', 'MACHINERY'), 'A', 'S') AS cust_type",
        )
    )


def _offer_at(slot: str) -> str:
    """Slots 0-13 hold the first fourteen offers, 14-15 none, 16-17 an unknown one."""
    ids = ", ".join(str(offer_id) for offer_id, _ in SEED_OFFERS[:14])
    return f"""CASE WHEN {slot} < 14 THEN element_at(array({ids}), {slot} + 1)
                    WHEN {slot} < 16 THEN NULL ELSE 9999999 END"""


def _typed(frame: DataFrame, schema: T.StructType) -> DataFrame:
    return frame.selectExpr(
        *[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]
    )


def events_tables(spark: SparkSession, sf_dir: str) -> Tables:
    facts = lambda: facts_of_events(sample(spark, sf_dir, "events"))
    return SampleTables(
        {
            **_lookups(spark),
            "customers": lambda: _customers(spark, sf_dir),
            "objects": lambda: _objects_of_events(facts()),
            "cdr_events": facts,
        }
    )


def _objects_of_events(facts: DataFrame) -> DataFrame:
    objects = (
        facts.groupBy("object_id", "cust_num")
        .agg(F.max("current_amount_expire_time").alias("expiry_date"))
        .selectExpr(
            "object_id AS object_id_bigint",
            "cust_num AS cust_num_bigint",
            "object_id % 10 + 1 AS object_type_id",
            "expiry_date",
        )
    )
    return _typed(objects, OBJECTS)


def facts_of_events(events: DataFrame) -> DataFrame:
    """``events``, a table or a stream of it, as facts."""
    numbered = events.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        """CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
           WHEN 'signup' THEN 4 ELSE 5 END AS operation""",
        "CAST(value AS DECIMAL(15,2)) AS v",
    )
    priced = numbered.selectExpr(
        "*",
        f"{_offer_at('k % 18')} AS offer_id",
        """CASE WHEN event_id % 97 = 0 THEN NULL
                WHEN operation > 3 THEN CAST(0 AS DECIMAL(15,2))
                WHEN event_id % 211 = 0 THEN CAST(-v AS DECIMAL(15,2)) ELSE v END AS deducted""",
        "CASE WHEN operation > 3 THEN v ELSE CAST(0 AS DECIMAL(15,2)) END AS charged",
    )
    facts = priced.selectExpr(
        "event_id AS cdr_event_id",
        "CAST(event_id AS STRING) AS cdr_id",
        "ts AS creation_time",
        "user_id AS cust_num",
        "user_id * 10 + k % 3 AS object_id",
        "offer_id",
        "operation AS operation_type_id",
        "deducted AS deduct_amount",
        "charged AS charge_amount",
        "2 * v AS current_amount_pre",
        "2 * v - deducted + charged AS current_amount_post",
        "CASE WHEN operation > 3 THEN ts + make_dt_interval(0, k - 20) END AS charge_expire_time",
        """CASE WHEN event_id % 3 <> 0 THEN ts + make_dt_interval(0, k * 5) END
           AS current_amount_expire_time""",
    )
    return _typed(facts, CDR_EVENTS)


def lineitem_tables(spark: SparkSession, sf_dir: str) -> Tables:
    orders = lambda: sample(spark, sf_dir, "orders")
    return SampleTables(
        {
            **_lookups(spark),
            "customers": lambda: _customers(spark, sf_dir),
            "objects": lambda: _objects_of_orders(orders()),
            "cdr_events": lambda: _facts_of_lineitem(sample(spark, sf_dir, "lineitem"), orders()),
        }
    )


def _objects_of_orders(orders: DataFrame) -> DataFrame:
    objects = orders.selectExpr(
        "o_orderkey AS object_id_bigint",
        "o_custkey AS cust_num_bigint",
        "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS object_type_id",
        """CASE WHEN o_orderkey % 11 <> 0
                THEN o_orderdate + make_dt_interval(CAST(o_orderkey % 730 AS INT)) END
           AS expiry_date""",
    )
    return _typed(objects, OBJECTS)


def _facts_of_lineitem(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    lines = lineitem.join(orders, F.expr("l_orderkey = o_orderkey"))
    # Every fourth customer never takes a loan: slots 7-13 are moved to 0-6.
    slotted = lines.withColumn(
        "slot",
        F.expr(
            """CAST(CASE WHEN o_custkey % 4 = 0 AND l_partkey % 18 BETWEEN 7 AND 13
                         THEN l_partkey % 18 - 7 ELSE l_partkey % 18 END AS INT)"""
        ),
    )
    price = "CAST(l_extendedprice AS DECIMAL(15,2))"
    nothing = "CAST(0 AS DECIMAL(15,2))"
    facts = slotted.selectExpr(
        "l_orderkey * 10 + l_linenumber AS cdr_event_id",
        "CAST(l_orderkey * 10 + l_linenumber AS STRING) AS cdr_id",
        "o_orderdate + make_dt_interval(0, l_linenumber) AS creation_time",
        "o_custkey AS cust_num",
        "o_orderkey AS object_id",
        f"{_offer_at('slot')} AS offer_id",
        "l_linenumber AS operation_type_id",
        f"CASE WHEN l_linenumber <= 3 THEN {price} ELSE {nothing} END AS deduct_amount",
        f"CASE WHEN l_linenumber > 3 THEN {price} ELSE {nothing} END AS charge_amount",
        "o_totalprice AS current_amount_pre",
        "o_totalprice - l_quantity AS current_amount_post",
        "CASE WHEN l_linenumber > 3 THEN l_shipdate END AS charge_expire_time",
        """CASE WHEN l_orderkey % 3 <> 0 THEN o_orderdate + make_dt_interval(30) END
           AS current_amount_expire_time""",
    )
    return _typed(facts, CDR_EVENTS)


def raw_extract(events: DataFrame) -> DataFrame:
    """``events`` (a table or a stream of it) as a raw extract, with the faults real ones have.

    Missing, blank, repeated and non-numeric ids, times that are no times or end in ``.0``,
    text in number columns, both customer types for one customer, type codes in both
    cases, unknown codes, operations and offers.
    """
    return events.withColumns(
        {
            "k": F.expr("CAST(get_json_object(props, '$.k') AS INT)"),
            "operation": F.expr(
                """CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                   WHEN 'signup' THEN 4 ELSE 5 END"""
            ),
            "v": F.expr("CAST(CAST(value AS DECIMAL(15,2)) AS STRING)"),
            "stamp": F.expr("date_format(ts, 'yyyyMMddHHmmss')"),
        }
    ).selectExpr(
        """CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN ' '
                WHEN event_id % 107 = 0 THEN 'CDR-' || event_id
                WHEN event_id % 50 = 1 THEN CAST(event_id - 1 AS STRING)
                ELSE CAST(event_id AS STRING) END AS CDR_ID""",
        """CASE WHEN event_id % 89 = 0 THEN 'not a time'
                WHEN event_id % 5 = 0 THEN stamp || '.0' ELSE stamp END AS CREATION_TIME""",
        """CASE WHEN event_id % 113 = 0 THEN 'unknown'
                WHEN event_id % 7 = 0 THEN user_id || '.0'
                ELSE CAST(user_id AS STRING) END AS CUST_NUM""",
        """CASE WHEN event_id % 127 = 0 THEN NULL WHEN event_id % 109 = 0 THEN 'Q'
                WHEN event_id % 2 = 0 THEN 'S' ELSE 'A' END AS CUST_TYPE""",
        "CAST(user_id * 10 + k % 3 AS STRING) AS OBJECT_ID",
        """element_at(array('F', 'f', 'B', 'C', 'c', 'Z', NULL), k % 7 + 1) AS OBJECT_type""",
        """CASE WHEN event_id % 131 = 0 THEN '0' WHEN event_id % 137 = 0 THEN '6'
                ELSE CAST(operation AS STRING) END AS OPERATION_TYPE""",
        """CASE WHEN k % 18 < 10 THEN CAST(7000000 + k % 18 AS STRING)
                WHEN k % 18 < 12 THEN '1482110' WHEN k % 18 < 14 THEN 'none'
                WHEN k % 18 < 16 THEN NULL ELSE '9999999' END AS OFFER_ID""",
        """CASE WHEN event_id % 83 = 0 THEN 'n/a' WHEN event_id % 97 = 0 THEN NULL
                WHEN operation > 3 THEN '0' ELSE v END AS DEDUCT_AMOUNT""",
        "CASE WHEN operation > 3 THEN v ELSE '0' END AS CHARGE_AMOUNT",
        "v AS CURENT_AMOUNT",
        "CASE WHEN event_id % 79 = 0 THEN NULL ELSE v END AS `CURENT_AMOUNT.2`",
        """CASE WHEN operation > 3
                THEN date_format(ts + make_dt_interval(0, k - 20), 'yyyyMMddHHmmss') || '.0' END
           AS CHARGE_AMOUNT_EXPIRE_TIME""",
        """CASE WHEN event_id % 3 <> 0
                THEN date_format(ts + make_dt_interval(0, k * 5), 'yyyyMMddHHmmss') END
           AS CURENT_AMOUNT_EXPIRE_TIME""",
    )


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a raw offer sheet; some ids repeat, some are unreadable."""
    return sample(spark, sf_dir, "part").selectExpr(
        """CASE WHEN p_partkey % 19 = 0 THEN 'x' || p_partkey
                WHEN p_partkey % 10 = 1 THEN CAST(6999999 + p_partkey AS STRING)
                WHEN p_partkey % 23 = 0 THEN '1482110'
                ELSE CAST(7000000 + p_partkey AS STRING) END AS OFfERID""",
        "p_name AS `Nom de l'offre`",
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return raw_extract(sample(spark, sf_dir, "events")), raw_offers(spark, sf_dir)
