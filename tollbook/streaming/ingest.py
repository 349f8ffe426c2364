"""Incremental loads from a folder that receives extracts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tollbook.sources.load import load_extract


def ingest_stream(
    raw: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Load every micro-batch of a raw stream into the store.

    A micro-batch goes through the same load as a whole extract. It skips ids that are
    stored, however long ago, so a batch repeated after a failure adds nothing twice and no
    streaming state has to remember ids. Its rejected rows are kept under a name made of the
    checkpoint and the batch, so streams and restarts do not overwrite each other's.
    ``trigger``: arguments of ``DataStreamWriter.trigger``; by default what is there is loaded.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def load(batch: DataFrame, batch_id: int) -> None:
        load_extract(batch.sparkSession, root, batch, batch=f"stream-{stream}-{batch_id}")

    return (
        raw.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
