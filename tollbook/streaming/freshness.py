"""How old the newest fact of a stream is."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tollbook.functions.calendar import minutes_between, moment
from tollbook.functions.measures import rows
from tollbook.operators.monitoring import HEALTHY, STALE
from tollbook.streaming.activity import require_utc


def freshness_stream(
    facts: DataFrame,
    as_of: datetime | None,
    path: str,
    checkpoint: str,
    fresh_minutes: int = 60,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the health of the stream after every micro-batch to ``path/<batch>``.

    The state is one row. ``as_of=None`` compares with the session's clock, in UTC as the facts'.
    """
    require_utc(facts.sparkSession)
    newest = facts.agg(F.max("creation_time").alias("latest_record"), rows().alias("total_records"))

    def report(batch: DataFrame, batch_id: int) -> None:
        now = moment(as_of) if as_of else F.current_timestamp().cast("timestamp_ntz")
        age = minutes_between(F.col("latest_record"), now)
        batch.select(
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            "latest_record",
            age.alias("minutes_since_last_record"),
            "total_records",
            F.when(age > fresh_minutes, STALE).otherwise(HEALTHY).alias("health_status"),
        ).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    return (
        newest.writeStream.outputMode("complete")
        .foreachBatch(report)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_health(spark: SparkSession, path: str) -> DataFrame:
    """The report on the newest fact, of whichever run; batch numbers start anew with a checkpoint."""
    reports = spark.read.parquet(path)
    newest = F.struct("latest_record", "total_records", "batch_id")
    return reports.groupBy().agg(
        F.max_by(F.struct(*[c for c in reports.columns if c not in ("batch", "batch_id")]), newest).alias("last")
    ).select("last.*")
