"""Exact order statistics and top rows that hold up when one key owns most rows."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 1024


def top_rows_per_key(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    rank_column: str,
    salts: int = 32,
) -> DataFrame:
    """The first ``limit`` rows of every key, numbered from 1.

    A first ranking within (key, salt) spreads a hot key over ``salts`` tasks and keeps at
    most ``limit`` rows of each; the second ranks what is left. Spark also cuts each group
    to ``limit`` rows before either shuffle. The salt hashes the whole row, so it is the same
    on a recomputed task; equal rows share a salt and are interchangeable.
    """
    salt = F.pmod(F.xxhash64(*frame.columns), F.lit(salts))
    within_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    within_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        frame.withColumn("_salt", salt)
        .withColumn("_place", F.row_number().over(within_salt))
        .filter(F.col("_place") <= limit)
        .drop("_salt", "_place")
        .withColumn(rank_column, F.row_number().over(within_key))
        .filter(F.col(rank_column) <= limit)
    )


def _magnitude_bucket(value: Column) -> Column:
    """An order-keeping bucket number: equal steps of the logarithm on both sides of zero."""
    size = F.floor(F.log2(F.abs(value).cast("double") * 100 + 1) * BUCKETS_PER_DOUBLING)
    return F.when(value.isNull(), F.lit(None).cast("bigint")).otherwise(
        F.when(value < 0, -size).otherwise(size)
    )


def nearest_rank(
    frame: DataFrame, column: str, shares: dict[str, Decimal], counted_where: Column | None = None
) -> Column:
    """Exact nearest-rank percentiles of a decimal amount column, as one scalar struct.

    Each is the value at position ``ceil(share * rows)`` in ascending order, NULLs first. No
    task sees all the values: rows are counted per distinct value, distinct values are added
    up per magnitude bucket, the few buckets (a fixed number per doubling, some 50,000 for
    all amounts up to a billion) are accumulated to find those that hold the wanted
    positions, and only the values of those buckets are put in order. A bucket spans less
    than 0.07 percent of its amounts, in steps of a cent, however many rows fall into it.

    ``counted_where`` limits the rows that count.
    """
    one_row = F.lit(1) if counted_where is None else F.when(counted_where, 1)
    counted = (
        frame.groupBy(F.col(column).alias("value"))
        .agg(F.count(one_row).alias("n"))
        .withColumn("bucket", _magnitude_bucket(F.col("value")))
    )
    ascending_buckets = Window.orderBy(F.asc_nulls_first("bucket"))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("share")) for k, v in shares.items()])
    )
    holding = (
        counted.groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .withColumn(
            "reached",
            F.sum("n").over(ascending_buckets.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn(
            "all_rows",
            F.sum("n").over(
                ascending_buckets.rowsBetween(
                    Window.unboundedPreceding, Window.unboundedFollowing
                )
            ),
        )
        .withColumn("wanted", wanted)
        .select(
            "bucket",
            F.col("wanted.name").alias("name"),
            (F.col("reached") - F.col("n")).alias("before"),
            "reached",
            F.ceil(F.col("wanted.share") * F.col("all_rows")).alias("position"),
        )
        .filter((F.col("before") < F.col("position")) & (F.col("position") <= F.col("reached")))
        .drop("reached")
    )
    ascending_values = Window.partitionBy("name").orderBy(F.asc_nulls_first("value"))
    # One row per wanted share, so the broadcast has a fixed size.
    located = (
        counted.alias("c")
        .join(F.broadcast(holding).alias("h"), F.col("c.bucket").eqNullSafe(F.col("h.bucket")))
        .select("name", "value", "n", "before", "position")
        .withColumn("reached", F.col("before") + F.sum("n").over(ascending_values))
        .filter(
            (F.col("reached") - F.col("n") < F.col("position"))
            & (F.col("position") <= F.col("reached"))
        )
    )
    return located.agg(
        F.struct(
            *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares]
        )
    ).scalar()
