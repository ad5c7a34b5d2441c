"""Answers of a generator as a streaming source of token pieces (M1 into X1).

Prompts are put into a ``PromptQueue``, a folder of Parquet files. The source
counts them: an offset is the number of responses that were asked for, in the
order of the queue. A micro-batch asks the generator for the responses between
two offsets, in tasks of a few prompts each, and gives ``(response_id, seq,
chunk)``. Spark keeps the offsets in the stream's checkpoint, so a restart asks
only for what was not committed and repeats no piece that was.

No server and no port: the generator is called in the tasks.
"""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from quarry.operators.generate import GeneratorFactory
from quarry.operators.routing import route_model, routes
from quarry.sources import shared
from quarry.sources.files import qualified
from quarry.streaming import token_reader

FIELDS = ["model", "num_ctx", "num_predict"]


class PromptQueue:
    """Prompts ``(response_id long, purpose, system, user)``, each with its
    route, in batches that count once they are complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def uri(self) -> str:
        return qualified(self.spark, self.path)

    def add(self, prompts: DataFrame, route_table: DataFrame | None = None) -> None:
        routed = route_model(prompts, routes(self.spark) if route_table is None else route_table)
        fs, at = shared.file_system(self.uri)
        batch = f"batch={len(token_reader.folders(fs, at, complete=False)):06d}-{uuid.uuid4().hex[:8]}"
        routed.selectExpr("cast(response_id as long) response_id", "purpose", "system", "user", *FIELDS).write.parquet(f"{self.path}/{batch}")


def token_stream(queue: PromptQueue, generator: GeneratorFactory) -> DataFrame:
    """The streaming frame ``(response_id, seq, chunk)`` over all prompts that
    are, or will be, in the queue. A response without text has no rows."""
    kind = f"quarry_tokens_{uuid.uuid4().hex[:8]}"
    for module in (shared, token_reader):
        cloudpickle.register_pickle_by_value(module)
    queue.spark.dataSource.register(token_reader.source_of(kind, queue.uri, cloudpickle.dumps(generator), FIELDS))
    return queue.spark.readStream.format(kind).load()
