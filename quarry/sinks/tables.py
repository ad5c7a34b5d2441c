"""Table sinks (K2-K5): results are written as new tables, never in place.

A write goes to the ``path`` that the caller names, which must not exist yet,
or else to a fresh folder under the shared checkpoint location
(``spark.checkpoint.dir``), so a retried or failed job never leaves a
half-updated snapshot behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.session import scratch_path


def write_snapshot(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as a new Parquet table and return the table read back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*df.columns)
