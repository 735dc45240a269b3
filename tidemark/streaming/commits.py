"""A stream of changes as epochs: each micro-batch is one commit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.epochs import EpochStore


def commit_stream(changes: DataFrame, store: EpochStore, table: str, checkpoint: str, step: int = 1, available_now: bool = True) -> StreamingQuery:
    """Commits each micro-batch of ``changes`` (op, seq, key and value columns) to ``table``, exactly once.

    The manifest entry of a micro-batch holds the stream's id, which its checkpoint keeps over restarts, and the batch's number, so a batch that is
    delivered again after a failure is found there and skipped, whatever else was committed to the store meanwhile.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        source = (json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"], number)
        entries = store.entries()
        if all(e.source != source for e in entries):
            store.commit(entries[-1].user + step, {table: batch}, source=source)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
