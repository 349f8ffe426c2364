"""What filters remove alone, together and in every order, from a stream of files.

Files come as micro-batches. Each document gets a mask of the filters it fails. The filter for repeated
texts cannot be known from one batch: a text's state keeps the smallest doc_id seen and its rows, and when
a smaller one arrives the rows that held the place are taken back from the counters of their old mask and
counted under the new one. Counters per part and mask are all that the orders need: what a filter removes
depends only on which filters stand before it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tollbook.llm.common import chunks, map_arrow, rename_free, session_of, written
from tollbook.session import shared_folder

LETTERS = "ABCDE"
BIT = {letter: 1 << n for n, letter in enumerate(LETTERS)}
# Micro-batches that the files are dealt to.
BATCHES = 4
# Different texts of a task that are folded at once.
FOLD_ROWS = 100_000
# Texts that share a state, on average.
BUCKET_TEXTS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MASKED = "doc_id long, part string, text_key binary, mask int, copies long"
FOLDED = "text_key binary, part string, mask int, good int, toxic int, least long, firsts long, later long, unnamed long"
STATE = "texts array<binary>, parts array<string>, least array<long>, good array<int>, toxic array<int>, firsts array<long>"
CHANGES = "part string, mask int, good int, toxic int, change long"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


@dataclass(frozen=True)
class Rules:
    """Limits of filters A to D; E is a text that a smaller doc_id has."""

    least_words: int = 100
    distinct_percent: int = 80
    capitals_percent: int = 10
    marks: str = "#$%&*|"

    def mask(self, text: bytes, n_chars: int) -> int:
        words = text.split()
        failed = BIT["A"] * (len(words) < self.least_words)
        failed |= BIT["B"] * (100 * len(set(words)) < self.distinct_percent * len(words))
        failed |= BIT["C"] * (100 * (len(text) - len(text.translate(None, UPPER))) > self.capitals_percent * n_chars)
        return failed | BIT["D"] * (len(text.translate(None, self.marks.encode())) < len(text))


def _masks(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sizes = pc.utf8_length(pc.fill_null(part["text"], "")).to_pylist()
            texts = pc.fill_null(part["text"], "").cast(pa.binary()).to_pylist()
            found: dict[tuple, list[int]] = {}
            for doc_id, name, text, size in zip(part["doc_id"].to_pylist(), part["lang"].to_pylist(), texts, sizes, strict=True):
                key = doc_id, name or "", hashlib.sha256(text).digest()
                if key in found:
                    found[key][1] += 1
                else:
                    found[key] = [rules.mask(text, size), 1]
            ids, parts, keys = zip(*found, strict=True)
            masks, copies = zip(*found.values(), strict=True)
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip((ids, parts, keys, masks, copies), kinds, strict=True)],
                ["doc_id", "part", "text_key", "mask", "copies"],
            )

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows of one text, part and labels as one row: smallest doc_id, its rows (0: there is none), those
    of others, those without doc_id."""
    names = [field.split()[0] for field in FOLDED.split(", ")]
    kinds = [pa.binary(), pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 4]
    found: dict[tuple, list] = {}

    def result() -> pa.RecordBatch:
        rows = [(*key, least or 0, *counts) for key, (least, *counts) in found.items()]
        found.clear()
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("text_key", "part", "mask", "good", "toxic", "doc_id", "copies")]
        for *key, doc_id, copies in zip(*columns, strict=True):
            held = found.setdefault(tuple(key), [None, 0, 0, 0])
            if doc_id is None:
                held[3] += copies
            elif held[0] is None or doc_id < held[0]:
                held[:3] = doc_id, copies, held[2] + held[1]
            else:
                held[1 if doc_id == held[0] else 2] += copies
        if len(found) > FOLD_ROWS:
            yield result()
    yield result()


def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New rows of a bucket's texts: counter changes for them and, where a smaller doc_id came, for the rows before."""
    # By text: the smallest doc_id, its labels, and its rows by part.
    texts: dict[bytes, list] = {}
    if state.exists:
        for text, part, least, good, toxic, firsts in zip(*state.get, strict=True):
            texts.setdefault(bytes(text), [least, good, toxic, {}])[3][part] = firsts
    changes: Counter = Counter()
    fresh: dict[bytes, list] = {}
    for frame in frames:
        for text, *row in zip(*(frame[c].tolist() for c in frame.columns[1:]), strict=True):
            fresh.setdefault(text, []).append(row)
    for text, rows in fresh.items():
        held = texts.get(text)
        mask = rows[0][1]
        repeated = mask | BIT["E"]
        new = min((least for *_, least, firsts, _, _ in rows if firsts), default=None)
        if new is not None and (held is None or new < held[0]):
            if held is not None:
                for part, n in held[3].items():
                    changes[part, mask, held[1], held[2]] -= n
                    changes[part, repeated, held[1], held[2]] += n
            held = texts[text] = [new, 0, 0, {}]
        for part, _, good, toxic, least, firsts, later, unnamed in rows:
            if firsts:
                first = least == held[0]
                changes[part, mask if first else repeated, good, toxic] += firsts
                changes[part, repeated, good, toxic] += later
                if first:
                    held[1:3] = good, toxic
                    held[3][part] = held[3].get(part, 0) + firsts
            changes[part, mask, good, toxic] += unnamed
    rows = [(text, part, least, good, toxic, n) for text, (least, good, toxic, parts) in texts.items() for part, n in parts.items()]
    if rows:
        state.update(tuple(map(list, zip(*rows, strict=True))))
    yield pd.DataFrame([(*k, n) for k, n in changes.items() if n], columns=["part", "mask", "good", "toxic", "change"])


def file_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files of ``path`` as a stream in about so many micro-batches, in a session of its own
    whose keyed state lives in RocksDB."""
    stored = spark.read.parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Each state partition would set aside some MB before it holds anything.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    files = stored.inputFiles()
    each = max(1, -(-len(files) // batches))
    folder, _, name = path.rstrip("/").rpartition("/")
    # A stream reads folders or patterns; a file is a pattern of one name.
    if len(files) == 1 and files[0].endswith(f"/{name}"):
        path = f"{folder}/{{{name}}}"
    return own.readStream.schema(stored.schema).option("maxFilesPerTrigger", each).parquet(path)


def count_masks(
    documents: DataFrame, labels: DataFrame, rules: Rules | None = None, buckets: int = 10_000,
    doc_id: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """``part, mask, good, toxic, n``: rows of a stream of documents by part, failed filters and labels.

    Runs the stream until what is there is processed. Texts are dealt to ``buckets`` by hash; a bucket's texts are one
    state, as calling a function for each single text costs much more than its work. Part is ``""`` for null, a null text is an empty one.
    Rows that repeat a doc_id with its text are not repeats of a smaller doc_id; rows without doc_id never
    fail E and make no other row fail it. A doc_id is good or toxic if any of its labels says so. An empty table gives no rows.
    """
    spark = session_of(documents)
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    marked = written(marked.select("doc_id", F.lit(0).alias("spread"), F.col("quality").alias("good"), "toxic"), "audit-labels")
    # The labels' session is not the stream's.
    marked = spark.read.schema(marked.schema).parquet(*marked.inputFiles()) if marked.inputFiles() else spark.createDataFrame([], marked.schema)
    named = map_arrow(rename_free(documents, {"doc_id": doc_id, "text": text, "lang": part}), _masks(rules or Rules()), MASKED)
    # Rows without doc_id meet no label; they are spread over the tasks of the join.
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text_key"), F.lit(1 << 20)) + 1).otherwise(0).cast("int")
    labelled = named.withColumn("spread", spread).join(marked, ["doc_id", "spread"], "left")
    labelled = labelled.select("doc_id", "part", "text_key", "mask", "copies", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    changes = (
        map_arrow(labelled, _fold, FOLDED)
        .select(F.pmod(F.xxhash64("text_key"), F.lit(buckets)).alias("bucket"), "*")
        .groupBy("bucket")
        .applyInPandasWithState(update, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)
    )
    counters = shared_folder(spark, "audit-counters")
    spark.createDataFrame([], CHANGES).write.parquet(f"{counters}/batch=-1")

    def count(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes its own folder again.
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("change"))
        summed.write.mode("overwrite").parquet(f"{counters}/batch={number}")

    (
        changes.writeStream.foreachBatch(count).outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", shared_folder(spark, "audit-checkpoint")).start().awaitTermination()
    )
    every = spark.read.schema(f"{CHANGES}, batch int").parquet(counters)
    return every.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("n")).where("n <> 0")


def orders(masks: DataFrame) -> DataFrame:
    """What each filter does in each order of the filters, per part: ``part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, zeros included.

    A filter's work depends on the set of filters before it: 80 pairs of a filter and such a set stand for
    the steps of the 120 orders. ``shapley`` is the filter's removals summed over all orders.
    """
    pairs = [
        (sum(before), own, math.factorial(len(before)) * math.factorial(len(BIT) - 1 - len(before)))
        for own in BIT.values()
        for size in range(len(BIT))
        for before in itertools.combinations([b for b in BIT.values() if b != own], size)
    ]
    pair = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(o).alias("own"), F.lit(w).alias("weight")) for b, o, w in pairs)))
    mask, before, own = (F.col(c) for c in ("mask", "before", "own"))
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    total = lambda hit, n: F.coalesce(F.sum(F.when(hit, F.col(n))), F.lit(0)).cast("long")
    done = (
        masks.groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
        .select("*", pair.alias("p")).select("part", "mask", "n", "good", "toxic", "p.*")
        .groupBy("part", "before", "own", "weight")
        .agg(
            total(~fails & ~gone, "n").alias("kept"), total(fails & ~gone, "n").alias("removed"), total(fails & gone, "n").alias("redundant"),
            total(mask == own, "n").alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
        )
    )
    shapley = done.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("weight")).cast("long").alias("shapley"))
    steps = [
        ("".join(order), step, sum(BIT[x] for x in order[: step - 1]), BIT[order[step - 1]])
        for order in itertools.permutations(LETTERS)
        for step in range(1, len(order) + 1)
    ]
    listed = masks.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")
    return done.join(shapley, ["part", "own"]).join(F.broadcast(listed), ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, rules: Rules | None = None, batches: int = BATCHES) -> DataFrame:
    """``orders`` of the documents in the Parquet files of ``path``."""
    buckets = 1 + spark.read.parquet(path).count() // BUCKET_TEXTS
    return orders(count_masks(file_stream(spark, path, batches), labels, rules, buckets))


ORACLE_SQL = """
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), marked AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), failed AS (
    SELECT words.doc_id, part, coalesce(good, 0) AS good, coalesce(marked.toxic, 0) AS toxic,
           len(w) < 100 AS a,
           100 * len(list_distinct(w)) < 80 * len(w) AS b,
           100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
           regexp_matches(text, '[#$%&*|]') AS d,
           coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY text), false) AS e
    FROM words LEFT JOIN marked ON marked.doc_id = words.doc_id
), letters(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), masks AS (
    SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
                 || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS mask,
           count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM failed GROUP BY ALL
), permutations AS (
    SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.letter, q.letter, r.letter, s.letter, t.letter])) = 5
), steps AS (
    SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter, substr(filter_order, 1, step::INT - 1) AS before
    FROM permutations, range(1, 6) AS s(step)
), done AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM (
        SELECT *, contains(mask, letter) AS fails,
               before <> '' AND mask <> '' AND regexp_matches(mask, '[' || before || '_]') AS gone
        FROM masks, steps
    ) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM done
"""
