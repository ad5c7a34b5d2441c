"""Vectors by the content of their text.

A table ``(hash, embedding)`` per model: each distinct text is embedded once,
however many chunks, files, builds, updates or streams hold it. New texts are
found by an anti join and embedded in one job, whose result is appended as one
complete folder; then the vectors are joined back to the chunks. A moved or
renamed file costs no call of the model.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "hash binary, embedding array<float>"


class VectorCache:
    """The vectors of one model (``model`` names it) below ``path``. ``embed``
    makes a vector column of a text column."""

    def __init__(self, spark: SparkSession, path: str, model: str, embed):
        self.spark, self.embed = spark, embed
        self.path = f"{path.rstrip('/')}/{model}"

    def load(self) -> DataFrame:
        """All cached vectors, one per text (two writers may have added one twice)."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [st.getPath().toString() for st in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))] \
            if fs.exists(p) else []
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*done).dropDuplicates(["hash"])

    def add(self, texts: DataFrame) -> None:
        """Embed the texts (``hash``, ``text``) that have no vector yet."""
        # a stated number of tasks: a model takes long for its bytes, and Spark would join small partitions to few
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        new = texts.repartition(tasks, "hash").dropDuplicates(["hash"]).join(self.load().select("hash"), "hash", "left_anti")
        vectors = new.select("hash", self.embed(F.col("text")).cast("array<float>").alias("embedding"))
        vectors.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def vectors(self, rows: DataFrame, text: Column, name: str = "embedding") -> DataFrame:
        """``rows`` with the vector of ``text`` under ``name``. The rows are read
        twice; a NULL text has the vector of the empty one."""
        keyed = rows.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_hash", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
        self.add(keyed.select(F.col("_hash").alias("hash"), F.col("_text").alias("text")))
        cached = self.load().select(F.col("hash").alias("_hash"), F.col("embedding").alias("_vector"))
        return keyed.join(cached, "_hash").withColumn(name, F.col("_vector")).drop("_hash", "_text", "_vector")
