"""Live progress of an embedding run.

Tasks count the rows they embed in an accumulator, which Spark adds up as tasks
end; a thread of the driver reads it while the job runs and calls back with the
count so far and the total. A task that runs again counts its rows again, so
the count is held at the total.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.embed import hashed_embedding
from quarry.operators.chunking import chunk_text
from quarry.operators.scan import scan_index_files


def count_chunks(files: DataFrame) -> int:
    """The chunks that an index of these files will have; nothing is embedded."""
    found = scan_index_files(files).select("path", "content")
    return chunk_text(found, "content", keep=["path"]).select("path").count()


class EmbedProgress:
    """``with EmbedProgress(spark, total, call) as p: store.save(build_index(files, embed=p.embed))``

    ``call(current, total)`` is called whenever the count has risen, and with
    the total at the end if the block succeeds. ``embed`` is the embedder that
    is watched (default: the hashed one)."""

    def __init__(self, spark: SparkSession, total: int, call: Callable[[int, int], None],
                 embed: Callable[[Column], Column] = hashed_embedding, every: float = 0.2):
        self.total, self.call, self.every = total, call, every
        self.counter, self._embed = spark.sparkContext.accumulator(0), embed
        self._stop, self._said = threading.Event(), 0

    def embed(self, text: Column) -> Column:
        counter = self.counter

        @pandas_udf("int")
        def counted(lengths: pd.Series) -> pd.Series:
            counter.add(len(lengths))
            return lengths

        # both functions are evaluated over the same batch
        return F.when(counted(F.length(F.coalesce(text, F.lit("")))) >= 0, self._embed(text))

    def _tell(self, current: int) -> None:
        if current > self._said:
            self._said = current
            self.call(current, self.total)

    def _watch(self) -> None:
        while not self._stop.wait(self.every):
            self._tell(min(self.counter.value, self.total))

    def __enter__(self) -> EmbedProgress:
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self._stop.set()
        self._thread.join()
        if kind is None:
            self._tell(self.total)
