"""Index maintenance driven by arriving change rows.

A row is a change of one file: ``op`` is ``put`` (with ``mtime`` and
``content``) or ``delete``. A change set may arrive in any number of
micro-batches; a file that no row names keeps its index rows, so nothing is
deleted because it has not arrived yet. Each micro-batch is published as one
delta of the store: its cost follows the change, not the index. The batch id
and the id that the checkpoint gives its stream are recorded with the version,
so a replayed batch is recognised and skipped, and the batches of another
stream on the same store are not taken for replays.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.indexing import changes_to_delta
from quarry.sinks.index_store import IndexStore

CHANGE_SCHEMA = "path string, mtime double, content string, op string"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to. It is written before
    the first batch and kept over restarts."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def update_from_stream(spark: SparkSession, store: IndexStore, input_dir: str, checkpoint: str,
                       available_now: bool = True, files_per_batch: int | None = None, patterns: DataFrame | None = None,
                       embed=None):
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def apply(batch: DataFrame, batch_id: int):
        tag = f"{stream_id(spark, checkpoint)}-batch-{batch_id}"
        if store.has_tag(tag):
            return
        batch = batch.persist()
        try:
            old = store.load_files(batch.select(F.col("path").alias("file")))  # opens what can hold them
            rows, gone = changes_to_delta(old, batch, embed=embed, patterns=patterns)
            store.save_delta(rows, gone, tag=tag)
        finally:
            batch.unpersist()

    w = reader.parquet(input_dir).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return q
