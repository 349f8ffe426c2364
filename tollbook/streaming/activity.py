"""Activity per hour or day, kept up to date from a stream of facts."""

from __future__ import annotations

import os
import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tollbook.functions.measures import rows, safe_ratio, zero_if_null


def require_utc(spark: SparkSession) -> None:
    """Watermarks need ``timestamp``; under UTC it reads the same as the wall clock."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC, it is {zone}")


def activity_stream(facts: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events, distinct customers and revenue per window of ``width``.

    A window is reported once, when the watermark passes its end, and its state is dropped
    then. Facts are folded to window and customer first, so the distinct count is exact and
    a busy customer or hour is combined in every task before it is shuffled. Facts later
    than ``delay`` are not counted here; ``activity_windows`` over the stored facts has them.
    """
    return _per_window(customer_stream(facts, width, delay))


def customer_stream(facts: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """What each customer has done per window of ``width`` so far."""
    require_utc(facts.sparkSession)
    return (
        facts.withColumn("at", F.col("creation_time").cast("timestamp"))
        .withWatermark("at", delay)
        .groupBy(F.window("at", width).alias("span"), "cust_num")
        .agg(rows().alias("n"), F.sum(zero_if_null(F.col("deduct_amount"))).alias("deducted"))
    )


def _per_window(per_customer: DataFrame) -> DataFrame:
    return (
        per_customer.groupBy("span")
        .agg(
            F.sum("n").alias("event_count"),
            F.count("cust_num").alias("active_users"),
            F.sum("deducted").alias("revenue"),
        )
        .select(
            F.col("span.start").cast("timestamp_ntz").alias("window_start"),
            F.col("span.end").cast("timestamp_ntz").alias("window_end"),
            "event_count",
            "active_users",
            F.col("revenue").cast("double").alias("total_revenue"),
            safe_ratio(F.col("revenue"), F.col("event_count")).alias("avg_transaction_value"),
        )
    )


def activity_windows(facts: DataFrame, width: str = "1 hour") -> DataFrame:
    """All windows of stored facts, late ones included: restates what the stream published."""
    require_utc(facts.sparkSession)
    return _per_window(
        facts.withColumn("at", F.col("creation_time").cast("timestamp"))
        .groupBy(F.window("at", width).alias("span"), "cust_num")
        .agg(rows().alias("n"), F.sum(zero_if_null(F.col("deduct_amount"))).alias("deducted"))
    )


def append_to_files(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> int:
    """Append the finished rows to Parquet files until the trigger ends; by default what is there is
    processed. Returns how many folded rows came too late for their window: one for each window and
    customer that a task of a micro-batch found too late, over all micro-batches of this run."""
    late = LateRows()
    late.listen(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    try:
        query.awaitTermination()
        return late.total(str(query.runId))
    finally:
        late.leave(stream.sparkSession)


class LateRows(StreamingQueryListener):
    """Rows that watermarks dropped, by run; a query itself remembers its last reports only."""

    def __init__(self):
        self._dropped: dict[str, int] = defaultdict(int)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def listen(self, spark: SparkSession) -> None:
        spark.streams.addListener(self)

    def leave(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._dropped[str(event.progress.runId)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def total(self, run: str, patience: float = 60.0) -> int:
        """All of an ended run; reports arrive in order, its end last."""
        if not self._ended[run].wait(patience):
            raise RuntimeError("the end of the stream was not reported")
        return self._dropped[run]


def publish_open(
    per_customer: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Publish windows while they are open: after every trigger ``open_activity`` is up to date.

    A micro-batch writes the new state of the customers it changed to a folder of its own number, the version of
    these rows. Run again after a failure it replaces that folder with the same rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        named = batch.select(
            F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "cust_num", "n", "deducted"
        )
        named.write.mode("overwrite").parquet(os.path.join(path, f"version={number}"))

    return (
        per_customer.writeStream.foreachBatch(put)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def open_activity(spark: SparkSession, path: str) -> DataFrame:
    """Activity per window, open ones included, from the newest version of every customer."""
    layout = "window_start timestamp, window_end timestamp, cust_num long, n long, deducted decimal(25,2), version long"
    newest = (
        spark.read.schema(layout).parquet(path)
        .groupBy(F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("span"), "cust_num")
        .agg(F.max_by(F.struct("n", "deducted"), "version").alias("last"))
    )
    return _per_window(newest.select("span", "cust_num", "last.n", "last.deducted"))
