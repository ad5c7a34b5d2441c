"""Incremental index maintenance as joins.

The index is a table ``(file, chunk_index, text, mtime, embedding)``; the
position-based id of a flat vector file becomes the explicit key
``(file, chunk_index)``, so keeping a vector is a semi join, not a lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_mtime(index: DataFrame) -> DataFrame:
    """A1: newest indexed mtime per file (missing mtime counts as 0.0)."""
    return index.groupBy("file").agg(
        F.max(F.coalesce(F.col("mtime").cast("double"), F.lit(0.0))).alias("mtime"))


def files_deleted(index: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed files absent from the current snapshot."""
    cur = current.select(F.col("path").alias("file"))
    return latest_mtime(index).select("file").join(cur, "file", "left_anti")


def files_new_or_changed(index: DataFrame, current: DataFrame) -> DataFrame:
    """Current files not indexed, or with an mtime strictly newer."""
    old = latest_mtime(index).withColumnRenamed("mtime", "indexed_mtime")
    cur = current.withColumnRenamed("path", "file")
    j = cur.join(old, "file", "left")
    return j.where(F.col("indexed_mtime").isNull() | (F.col("mtime") > F.col("indexed_mtime"))) \
        .drop("indexed_mtime")


def file_status(index: DataFrame, current: DataFrame) -> DataFrame:
    """Every file of either side with ``status``: new, changed (strictly newer
    mtime), unchanged, or deleted. One aggregate over the index's
    ``(file, mtime)`` columns and one join on ``file``; content is not carried."""
    old = latest_mtime(index).withColumnRenamed("mtime", "indexed_mtime")
    cur = current.select(F.col("path").alias("file"), "mtime", F.lit(True).alias("present"))
    j = cur.join(old, "file", "full_outer")
    # a file without an mtime is present all the same, and counts as not newer
    status = (F.when(F.col("present").isNull(), F.lit("deleted"))
              .when(F.col("indexed_mtime").isNull(), F.lit("new"))
              .when(F.col("mtime") > F.col("indexed_mtime"), F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    return j.select("file", "mtime", "indexed_mtime", status.alias("status"))


def files_unchanged(index: DataFrame, current: DataFrame) -> DataFrame:
    """Current files that are indexed with an mtime at least as new (the
    complement of J4 within the snapshot)."""
    old = latest_mtime(index).withColumnRenamed("mtime", "indexed_mtime")
    cur = current.select(F.col("path").alias("file"), "mtime")
    return cur.join(old, "file", "inner").where(F.coalesce(F.col("mtime") <= F.col("indexed_mtime"), F.lit(True))) \
        .select("file")


def chunks_kept(index: DataFrame, current: DataFrame) -> DataFrame:
    """Index rows of unchanged files, vectors reused as they are."""
    return index.join(files_unchanged(index, current), "file", "left_semi")


def files_except(a: DataFrame, b: DataFrame, col: str = "file") -> DataFrame:
    """Distinct names in ``a`` but not in ``b``."""
    return a.select(col).subtract(b.select(col))


def merge_index(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union of kept and new rows (by column name)."""
    return kept.unionByName(new)


def distinct_files(df: DataFrame, col: str = "file") -> DataFrame:
    """The set of file names."""
    return df.select(col).dropDuplicates()


def index_stats(old: DataFrame, kept: DataFrame, new: DataFrame) -> DataFrame:
    """A5: one row ``(added, removed, unchanged)``; three partial aggregates."""
    n_old = old.agg(F.count(F.lit(1)).alias("n_old"))
    n_kept = kept.agg(F.count(F.lit(1)).alias("unchanged"))
    n_new = new.agg(F.count(F.lit(1)).alias("added"))
    return n_new.crossJoin(n_old).crossJoin(n_kept).select(
        F.col("added").cast("bigint"),
        (F.col("n_old") - F.col("unchanged")).cast("bigint").alias("removed"),
        F.col("unchanged").cast("bigint"),
    )


def embed_progress(chunks: DataFrame) -> DataFrame:
    """Per file, the running position of each chunk and the file's total.

    Progress is counted per file, so no window spans the whole run.
    """
    w = Window.partitionBy("file").orderBy("chunk_index")
    return chunks.select(
        "file", "chunk_index",
        F.row_number().over(w).cast("bigint").alias("current"),
        F.count(F.lit(1)).over(Window.partitionBy("file")).cast("bigint").alias("total"),
    )
