"""Ids of the stored facts in hash buckets, so that a load reads those that its own ids can be among.

The index follows the fact table: it knows which fact files it holds and takes in the others before it
is asked. A load that was cut short anywhere is caught up with by the next one.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollbook.sources.files import folder_exists, remove_folder
from tollbook.sources.tables import load_table

BUCKETS = 256
IDS, FILES = "cdr_id string, bucket int", "file string"


def bucket_of(cdr_id: Column) -> Column:
    return F.pmod(F.xxhash64(cdr_id), F.lit(BUCKETS)).cast("int")


def _paths(root: str) -> tuple[str, str]:
    return os.path.join(root, "_known_ids", "ids"), os.path.join(root, "_known_ids", "files")


def catch_up(spark: SparkSession, root: str) -> int:
    """Take in fact files that the index does not hold; returns how many. Where files it holds are gone,
    as after a reset, it starts anew. Files taken in twice after a crash do no harm."""
    ids_at, files_at = _paths(root)
    stored = load_table(spark, root, "cdr_events")
    current = set(stored.inputFiles())
    held = set()
    if folder_exists(spark, files_at):
        held = {r["file"] for r in spark.read.schema(FILES).parquet(files_at).collect()}
    if held - current:
        for path in (files_at, ids_at):
            remove_folder(spark, path)
        held = set()
    fresh = sorted(current - held)
    if fresh:
        ids = spark.read.schema("cdr_id string").parquet(*fresh).withColumn("bucket", bucket_of(F.col("cdr_id")))
        gathered = ids.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "cdr_id")
        gathered.write.mode("append").partitionBy("bucket").parquet(ids_at)
        spark.createDataFrame([(f,) for f in fresh], FILES).coalesce(1).write.mode("append").parquet(files_at)
    return len(fresh)


def known_ids(spark: SparkSession, root: str, batch: DataFrame) -> DataFrame | None:
    """Stored ids in the buckets that the batch's ids fall in, or None while nothing is stored.

    The bucket numbers of the batch, a bounded set, choose the folders to read.
    """
    catch_up(spark, root)
    ids_at, _ = _paths(root)
    if not folder_exists(spark, ids_at):
        return None
    wanted = [r["bucket"] for r in batch.select(bucket_of(F.col("cdr_id")).alias("bucket")).distinct().collect()]
    return spark.read.schema(IDS).parquet(ids_at).filter(F.col("bucket").isin(wanted)).select("cdr_id")
