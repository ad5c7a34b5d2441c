"""Source trees as DataFrames (S1, S2, S4 over real files).

``read_tree`` lists a directory recursively with the ``binaryFile`` source
and returns the engine's snapshot shape ``(path, mtime, content, n_bytes,
source)`` with root-relative paths. The extension list is pushed into the
listing as a case-insensitive ``pathGlobFilter``, so files of other types are
never opened; unreadable files are skipped (``ignoreCorruptFiles``). Note that
``binaryFile`` omits zero-byte files - they would yield no chunks anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.operators.scan import read_text


def _ci_glob(exts: list[str]) -> str:
    """``*.{[pP][yY],...}``: a case-insensitive glob for the extensions."""
    alts = []
    for e in exts:
        body = e.lstrip(".")
        alts.append("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in body))
    return "*.{" + ",".join(alts) + "}"


def qualified(spark: SparkSession, root: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString().rstrip("/")


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = K.INDEX_EXTENSIONS,
              source: str | None = None) -> DataFrame:
    """Snapshot of the files under ``root`` (text decoded as in S4)."""
    reader = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("ignoreCorruptFiles", "true"))
    if extensions:
        reader = reader.option("pathGlobFilter", _ci_glob(extensions))
    raw = reader.load(root)
    prefix = qualified(spark, root) + "/"
    rel = F.expr(f"substring(path, {len(prefix) + 1})")
    snap = raw.select(
        rel.alias("path"),
        (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"),
        F.col("content"),
        F.col("length").alias("n_bytes"),
        F.lit(source or root.rstrip("/").split("/")[-1]).alias("source"),
    )
    return read_text(snap, "content")
