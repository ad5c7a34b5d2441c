"""Answers of a model, logged as they come (M1).

A call is known by a hash of all that the model is given. Tasks append answers
to small Parquet files under ``slice=<hash part>`` and read the files of their
slices first, so a call that was answered is not made again: not by the retry
of a lost task, and not by a later run that names the same log. Failed calls
are logged with their error and made again by the next run.

Files appear under their name when they are complete. They are written and read
in tasks through the file system that the path names (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.files import qualified
from quarry.sources.shared import file_system, listed, publish

#: Parts of a log. A task holds the keys of the parts dealt to it.
SLICES = 1024
#: A file is written when a part has so many new answers, and at the latest so
#: many seconds after the last ones: what a worker that dies can lose. (One
#: that fails writes what it has.)
ANSWERS_PER_FILE, SECONDS_PER_FILE = 256, 30.0
SCHEMA = "key string, response string, error string, at double"
_ARROW = pa.schema([("key", pa.string()), ("response", pa.string()), ("error", pa.string()), ("at", pa.float64())])


class AnswerLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, part: int) -> str:
        return f"{qualified(self.spark, self.path)}/slice={part:04d}"

    def fill(self, calls: DataFrame, generator: Callable, fields: list[str]) -> int:
        """Make the calls (``key``, ``user``, ``system``, ``purpose`` and the
        route's ``fields``) that have no answer yet; returns their number. Rows
        are ordered by model within a task, which so switches once per model."""
        root = qualified(self.spark, self.path)
        names = ["key", "part", "user", "system", "purpose", *fields]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, at = file_system(root)
            known: dict[int, set[str]] = {}
            waiting: dict[int, list] = {}
            call, made, written = None, 0, time.monotonic()

            def flush(part: int) -> None:
                if rows := waiting.pop(part, []):
                    out = io.BytesIO()
                    pq.write_table(pa.Table.from_pylist(rows, _ARROW), out)
                    publish(fs, f"{at}/slice={part:04d}", f"{uuid.uuid4().hex}.parquet", out.getvalue())

            try:
                for pdf in batches:
                    for key, part, user, system, purpose, *route in pdf[names].itertuples(index=False):
                        if part not in known:
                            tables = [pq.read_table(f, filesystem=fs, columns=["key", "error"]) for f in listed(fs, f"{at}/slice={part:04d}")]
                            known[part] = {k for t in tables for k, e in zip(t["key"].to_pylist(), t["error"].to_pylist()) if e is None}
                        if key in known[part]:
                            continue
                        call = call or generator()  # the model is loaded by the first call of a task
                        response = error = None
                        try:
                            response = call(user, system, purpose, dict(zip(fields, route)))
                            response = response.strip() if response is not None else None
                        except Exception as e:  # one failed request is a row with its error
                            error = f"{type(e).__name__}: {e}"
                        known[part].add(key)
                        waiting.setdefault(part, []).append({"key": key, "response": response, "error": error, "at": time.time()})
                        made += 1
                        if len(waiting[part]) >= ANSWERS_PER_FILE:
                            flush(part)
                        if time.monotonic() - written >= SECONDS_PER_FILE:
                            for other in list(waiting):
                                flush(other)
                            written = time.monotonic()
            finally:
                for part in list(waiting):
                    flush(part)
            yield pd.DataFrame({"made": [made]})

        asked = calls.dropDuplicates(["key"]).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int")).select(*names)
        # a stated number of tasks: calls take long for their bytes, and Spark would join small partitions to few
        tasks = min(SLICES, max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        made = asked.repartition(tasks, "part").sortWithinPartitions("model", "part").mapInPandas(run, "made long")
        return made.agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]

    def answers(self) -> DataFrame:
        """``key, response, error``: the answer of each call made so far, of
        several the latest without an error, if there is one."""
        fs, at = file_system(qualified(self.spark, self.path))
        if not fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            return self.spark.createDataFrame([], SCHEMA).drop("at")
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        best = F.max_by(F.struct("response", "error"), F.struct(F.col("error").isNull(), "at")).alias("a")
        return rows.groupBy("key").agg(best).select("key", "a.*")
