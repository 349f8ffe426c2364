"""Table layouts of the star schema and the rows every new store starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AMOUNT = T.DecimalType(15, 2)


def _layout(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


CUSTOMERS = _layout(cust_num_bigint=T.LongType(), cust_type=T.StringType())

OBJECT_TYPES = _layout(
    object_type_id=T.IntegerType(),
    object_type_code=T.StringType(),
    description=T.StringType(),
)

OBJECTS = _layout(
    object_id_bigint=T.LongType(),
    cust_num_bigint=T.LongType(),
    object_type_id=T.IntegerType(),
    expiry_date=T.TimestampNTZType(),
)

OFFERS = _layout(offer_id=T.IntegerType(), offer_name=T.StringType())

OPERATION_TYPES = _layout(operation_type_id=T.ShortType(), description=T.StringType())

CDR_EVENTS = _layout(
    cdr_event_id=T.LongType(),
    cdr_id=T.StringType(),
    creation_time=T.TimestampNTZType(),
    cust_num=T.LongType(),
    object_id=T.LongType(),
    offer_id=T.IntegerType(),
    operation_type_id=T.ShortType(),
    deduct_amount=AMOUNT,
    charge_amount=AMOUNT,
    current_amount_pre=AMOUNT,
    current_amount_post=AMOUNT,
    charge_expire_time=T.TimestampNTZType(),
    current_amount_expire_time=T.TimestampNTZType(),
)

# Stored facts carry their month so that a trailing window reads few folders.
EVENT_MONTH = "event_month"
CDR_EVENTS_STORED = T.StructType(
    CDR_EVENTS.fields + [T.StructField(EVENT_MONTH, T.StringType(), True)]
)

LAYOUTS = {
    "customers": CUSTOMERS,
    "object_types": OBJECT_TYPES,
    "objects": OBJECTS,
    "offers": OFFERS,
    "operation_types": OPERATION_TYPES,
    "cdr_events": CDR_EVENTS_STORED,
}

# The catalogue rows a new store holds.
SEED_OBJECT_TYPES = [
    (1, "F", "Free Resource"),
    (2, "B", "Main Balance"),
    (3, "C", "Credit Balance"),
]
SEED_OFFERS = [
    (1482110, "10 min MaxPlus"),
    (1050552, "Pass NCD 200Mo"),
    (3771305, "Khamssa Data"),
    (1477069, "Khamssa Voix"),
    (9430556, "1H_Internet_Illimite"),
    (1853344, "3H_Data_Illimite"),
    (1853351, "5H_Data_Illimite"),
    (1482815, "Loan_35Mo"),
    (1582989, "Loan_3Min_6SMS_5Mo"),
    (1382991, "Loan_70Mo"),
    (5829986, "Loan_6Min_12SMS_15Mo"),
    (5830005, "Loan_150Mo"),
    (1883001, "Loan_12Min_24SMS_35Mo"),
    (1483001, "Loan_400Mo"),
    (1883002, "Loan_30Min_60SMS_120Mo"),
]
SEED_OPERATION_TYPES = [
    (1, "Usage - Type 1"),
    (2, "Usage - Type 2"),
    (3, "Usage - Type 3"),
    (4, "Add new Free Resource"),
    (5, "Add to existing Free Resource"),
]


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few constant rows as a VALUES relation, so Spark knows how small they are."""

    def literal(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    typed = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema)
    return spark.sql(f"SELECT {typed} FROM VALUES {body} AS t({', '.join(schema.names)})")


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table of one partition."""
    columns = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]
    return spark.range(0, 0, 1, 1).selectExpr(*columns)


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "object_types": literal_rows(spark, SEED_OBJECT_TYPES, OBJECT_TYPES),
        "offers": literal_rows(spark, SEED_OFFERS, OFFERS),
        "operation_types": literal_rows(spark, SEED_OPERATION_TYPES, OPERATION_TYPES),
    }
