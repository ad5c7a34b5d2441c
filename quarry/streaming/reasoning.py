"""Streaming reasoning split (X1) and the token line stream.

X1 applies the tokens of a response in ``seq`` order, whatever the order of
their arrival: a token that is early waits in the state until the gap before it
closes, a token that was already applied is a replay and is skipped. The state
of a response has two variables: a value with the next ``seq``, the flag, two
lengths and the number of early tokens, and a map from ``seq`` to early token.
A micro-batch reads and writes only the entries of its own tokens and of gaps
that they close. The texts are in the output rows, one per token with what it
adds to each part, the running lengths and the flag.

A timer ends the wait of a response without tokens for ``idle_ms``: its early
tokens are applied in order, without the missing ones. The value stays for
``reasoning_state.KEEP_MS`` (its TTL), so a response that goes on afterwards continues where it
was. After an ``availableNow`` run, ``waiting_tokens`` applies what waits. The
last row of a response equals the batch ``split_reasoning`` (W3), and every
state can be rebuilt from the rows. Keyed state needs the RocksDB store, which
``run_available`` sets for its query.
"""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.operators.responses import parsed_line, parse_response_lines
from quarry.streaming import reasoning_state
from quarry.streaming.reasoning_state import Reasoning, rows_of

OUT_SCHEMA = ("response_id long, seq long, thinking_delta string, final_delta string, "
              "thinking_len long, final_len long, is_thinking boolean")
TOKEN_SCHEMA = "response_id long, seq long, chunk string"
#: Default idle time after which early tokens wait no longer.
IDLE_MS = 600_000
TAGS = (K.THINK_OPEN, K.THINK_CLOSE)


def processor(idle_ms: int | None) -> Reasoning:
    return Reasoning(idle_ms, TAGS)


def split_reasoning_stream(tokens: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """X1 on a streaming token frame ``(response_id, seq, chunk)`` whose
    ``seq`` counts from 0 within a response; a NULL chunk adds nothing.

    ``idle_ms`` None keeps the state until the query ends: for ``availableNow``
    runs, which end when the input is drained. What then still waits behind a
    missing ``seq`` is in ``waiting_tokens``.
    """
    cloudpickle.register_pickle_by_value(reasoning_state)  # Spark also starts it where the package is not
    return tokens.groupBy("response_id").transformWithStateInPandas(
        processor(idle_ms), OUT_SCHEMA, "Append", "ProcessingTime" if idle_ms else "None")


def waiting_tokens(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The early tokens that wait in the state after a run, applied in order
    without the missing ones: with the rows of the sink they are the whole
    answers. The state stays as it is, so a next run from the checkpoint can
    still close the gaps; its own waiting tokens then replace these."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/[0-9]*")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
        return spark.createDataFrame([], OUT_SCHEMA)
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    head = state("head").where("value.n_early > 0").select("key.response_id", "value.*")
    early = state("early").select("key.response_id", F.col("user_map_key.seq").alias("seq"), F.col("user_map_value.chunk").alias("chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first = pdf.sort_values("seq"), pdf.iloc[0]
        return rows_of(first.response_id, dict(zip(pdf.seq.tolist(), pdf.chunk.tolist())), bool(first.flag), int(first.thinking_len), int(first.final_len), TAGS)

    return early.join(head, "response_id").groupBy("response_id").applyInPandas(run, OUT_SCHEMA)


def split_lines(lines: DataFrame) -> DataFrame:
    """X2 record format: ``response_id TAB line_no TAB raw_json_line``."""
    p = F.split(F.col("value"), "\t", 3)
    return lines.select(F.get(p, 0).cast("long").alias("response_id"),
                        F.get(p, 1).cast("long").alias("line_no"),
                        F.get(p, 2).alias("line"))


def parse_line_records(lines: DataFrame) -> DataFrame:
    """X2 records -> tokens."""
    return parse_response_lines(split_lines(lines)).select("response_id", "line_no", "token")


def line_tokens(lines: DataFrame) -> DataFrame:
    """X2 records as X1's input: every line is a ``seq``, and a line without a
    token (blank, malformed, no answer) a NULL chunk, which closes its gap."""
    rec = split_lines(lines)
    return rec.select("response_id", F.col("line_no").alias("seq"), parsed_line(F.col("line")).alias("chunk"))


def response_stream(spark: SparkSession, input_dir: str) -> DataFrame:
    """An unbounded text source of model output lines -> tokens."""
    return parse_line_records(spark.readStream.text(input_dir))


def response_reasoning_stream(spark: SparkSession, input_dir: str, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """X2 into X1: model output lines -> reasoning states. Lines of a response
    are numbered from 0."""
    return split_reasoning_stream(line_tokens(spark.readStream.text(input_dir)), idle_ms)


@contextmanager
def keyed_state(spark: SparkSession):
    """The RocksDB state store for queries that start meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(df: DataFrame, sink_dir: str, checkpoint: str, fmt: str = "parquet"):
    """Drain everything available with an ``availableNow`` trigger. A query
    with an idle timeout would never be drained: pass ``idle_ms=None``."""
    with keyed_state(df.sparkSession):
        q = (df.writeStream.format(fmt).option("path", sink_dir).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
