"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship_package
from quarry.sources.tables import table

__all__ = ["forget", "materialize", "quoted", "scratch_path", "sha256_text", "ship_package", "slices", "table", "texts"]


def quoted(name: str) -> str:
    """A column name as Spark reads it whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and ``text`` (NULL text: empty) and, if ``keep`` names
    columns, the struct ``kept`` of them. No other column of the input can
    clash with the columns an operator makes."""
    ship_package(docs.sparkSession)
    kept = [F.struct(*map(quoted, keep)).alias("kept")] if keep else []
    return docs.select(
        F.col(quoted(id_col)).cast("long").alias("doc_id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"), *kept)


def slices(batch: pa.RecordBatch, most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text (or one row), so
    that a task's memory follows neither the batch nor the partition."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it
    back: later jobs neither recompute it nor depend on a single executor. The
    shuffle files behind it are removed once it is written."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def sha256_text(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
