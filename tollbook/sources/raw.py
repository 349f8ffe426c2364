"""Raw extracts: every column arrives as text and is conformed later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The header lines of the two sheets.
FACT_HEADERS = (
    "CDR_ID",
    "CREATION_TIME",
    "CUST_NUM",
    "CUST_TYPE",
    "OBJECT_ID",
    "OBJECT_type",
    "OPERATION_TYPE",
    "OFFER_ID",
    "DEDUCT_AMOUNT",
    "CHARGE_AMOUNT",
    "CURENT_AMOUNT",
    "CURENT_AMOUNT.2",
    "CHARGE_AMOUNT_EXPIRE_TIME",
    "CURENT_AMOUNT_EXPIRE_TIME",
)
OFFER_HEADERS = ("OFfERID", "Nom de l'offre")


def read_raw(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    columns: Sequence[str] | None = None,
    **options: str,
) -> DataFrame:
    """An extract sheet saved as CSV, JSON lines, Parquet or ORC, all columns as strings.

    CSV takes its columns from the header line. JSON lines name theirs row by row: without
    ``columns`` Spark has to read the file once to find them.
    """
    reader = spark.read.options(**options)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=False)
    if fmt == "json":
        if columns is not None:
            return reader.schema(all_text(columns)).json(path)
        return reader.json(path, primitivesAsString=True)
    if fmt in ("parquet", "orc"):
        return as_text(reader.format(fmt).load(path))
    raise ValueError(f"unknown raw format {fmt!r}")


def all_text(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def as_text(frame: DataFrame) -> DataFrame:
    return frame.select([F.col(f"`{name}`").cast("string").alias(name) for name in frame.columns])
