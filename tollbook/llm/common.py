"""Helpers the operators share: Arrow batches of bounded size, bit filters, connected groups."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tollbook.session import shared_folder

# Text handled at once in a task, in UTF-8 bytes.
CHUNK_BYTES = 4 << 20
# Rows handed to a Python worker at once, in bytes. Spark's default is a number of rows, which may be of any size.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Rows that Parquet's reader holds at once. Spark's default, 4,096, are buffers of many MB for whole texts, which make an
# executor's heap grow to its limit.
READ_ROWS = 512
READ_SETTING = "spark.sql.parquet.columnarReaderBatchSize"
# Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bits of a key filter: 8 MB whatever the number of keys.
FILTER_BITS = 1 << 26
BITMAP_BITS = 1 << 15


def session_of(frame: DataFrame) -> SparkSession:
    """The frame's session. Python workers import this package from where the driver has it, and
    get rows in batches of ``BATCH_BYTES``, and tables are read ``READ_ROWS`` at a time, if the session says nothing else."""
    spark = frame.sparkSession
    for setting, value in ((BATCH_SETTING, BATCH_BYTES), (READ_SETTING, READ_ROWS)):
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, str(value))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def give_back() -> None:
    """Return free memory to the system: a worker stays for other tasks, and its allocators keep what was once used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(frame: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    session_of(frame)
    return frame.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Cut batches so that a chunk holds about ``CHUNK_BYTES`` of a text column, one row at least."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = [v or 0 for v in pc.binary_length(table[column]).to_pylist()]
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > CHUNK_BYTES:
                yield table.slice(start, row - start)
                start, held = row, 0
            held += size
        if len(sizes) > start:
            yield table.slice(start)


def forget(known: dict, most: int) -> None:
    """Drop the older half of what a worker remembers once there is more than ``most``."""
    if len(known) > most:
        for key in list(islice(known, len(known) // 2)):
            del known[key]


def written(frame: DataFrame, purpose: str, *folders: str) -> DataFrame:
    """The frame as stored in the shared folder: lineage is cut, lost executors cost nothing, and the shuffles behind it are gone.

    ``folders`` are columns with few values; rows that differ in them stand in folders of their own."""
    spark = session_of(frame)
    path = shared_folder(spark, purpose)
    before = spark.conf.get(CLEAN_SETTING, "false")
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        frame.write.parquet(path, partitionBy=list(folders) or None)
    finally:
        spark.conf.set(CLEAN_SETTING, before)
    return spark.read.schema(frame.schema).parquet(path)


def rename_free(frame: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns, as ``{new name: old name}``; others cannot clash with ours."""
    return frame.select(*(F.col(f"`{old}`").alias(new) for new, old in wanted.items()))


def _bit(key) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """``keys`` as at most 2048 bitmaps of 4 KB, a size that does not grow with the keys."""
    bit = _bit(F.col(key))
    return (
        keys.where(F.col(key).isNotNull())
        .select(
            (bit / BITMAP_BITS).cast("long").alias("_bucket"),
            F.pmod(bit, F.lit(BITMAP_BITS)).alias("_position"),
        )
        .groupBy("_bucket")
        .agg(F.expr("bitmap_construct_agg(_position)").alias("_bits"))
    )


def marked(frame: DataFrame, key: str, keys: DataFrame, keys_key: str, mark: str) -> DataFrame:
    """All rows, with a column ``mark`` that says whether their key may be among ``keys``.

    Some rows are marked that have no such key, never the other way round; with very many keys all are.
    """
    bit = _bit(F.col(key))
    position = F.pmod(bit, F.lit(BITMAP_BITS))
    byte = F.conv(
        F.hex(F.substring(F.col("_bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10
    ).cast("int")
    filters = F.broadcast(bit_filter(keys, keys_key))
    found = F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1
    return (
        frame.withColumn("_bucket", (bit / BITMAP_BITS).cast("long"))
        .join(filters, "_bucket", "left")
        .withColumn(mark, F.coalesce(found, F.lit(False)))
        .drop("_bucket", "_bits")
    )


def prefilter(frame: DataFrame, key: str, keys: DataFrame, keys_key: str) -> DataFrame:
    """Rows whose key may be among ``keys``, before a join shuffles them.

    Some rows pass that have no such key, never the other way round; with very many keys all
    rows pass and the join still decides.
    """
    return marked(frame, key, keys, keys_key, "_may").where("_may").drop("_may")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges ``(a, b)`` of a task as stars: every node with the smallest node it reaches."""
    above: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while (up := above.setdefault(top, top)) != top:
            top = up
        while node != top:
            above[node], node = top, above[node]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    linked = [(node, root(node)) for node in above]
    linked = [(a, b) for a, b in linked if a != b]
    for start in range(0, len(linked), 10_000):
        part = linked[start : start + 10_000]
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array([x[0] for x in part], pa.int64()), "b": pa.array([x[1] for x in part], pa.int64())}
        )


def _hooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(a, b)`` sorted by both: each ``a`` with its least ``b``, its parent, and its other ones with that one too."""
    node = least = None
    for batch in batches:
        a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
        if not len(a):
            continue
        first = np.r_[a[0] != node, a[1:] != a[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
        own = np.where(start >= 0, b[np.maximum(start, 0)], least if least is not None else 0)
        node, least = a[-1], own[-1]
        keep = first | (b != own)
        yield pa.RecordBatch.from_pydict(
            {"a": np.where(first, a, b)[keep], "b": own[keep], "parent": first[keep]},
            schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("parent", pa.bool_())]),
        )


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """Connected groups of an edge list ``(a, b)`` of longs: ``(node, component)``.

    ``component`` is the smallest node of the group. A task first reduces its edges to stars, so a node has one link
    a task at most, however many edges there are. Then each node takes the least node it is linked with as its parent and
    ties the others to that one. Nodes that are nobody's parent are settled by this; only the others go into the next
    round, whose answer is passed down at the end. Rounds shrink fast, as long as the numbers of neighbours are in
    no order (they are hashes here). Everything is written to the shared folder. Nodes without edges are
    not returned; an empty edge list gives no rows.
    """
    links = "a long, b long"
    current = written(map_arrow(edges.where("a <> b").select("a", "b"), forest, links), purpose)
    levels: list[DataFrame] = []
    while not current.isEmpty():
        met = current.repartition("a").sortWithinPartitions("a", "b")
        hooked = written(map_arrow(met, _hooks, f"{links}, parent boolean"), purpose)
        parents, tied = hooked.where("parent").select("a", "b"), hooked.where("not parent").select("a", "b")
        levels.append(parents)
        # Parents that have a parent themselves, or more than one way down.
        inner = hooked.select(F.col("b").alias("a")).unionByName(tied.select("a")).distinct()
        current = written(map_arrow(tied.unionByName(parents.join(inner, "a", "left_semi")), forest, links), purpose)
    if not levels:
        return edges.limit(0).select(F.col("a").alias("node"), F.col("b").alias("component"))
    settled = levels.pop()
    while levels:
        above = settled.select(F.col("a").alias("b"), F.col("b").alias("top"))
        passed = levels.pop().join(above, "b", "left").select("a", F.coalesce("top", "b").alias("b"))
        settled = written(passed.unionByName(settled).distinct(), purpose)
    roots = settled.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return settled.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
