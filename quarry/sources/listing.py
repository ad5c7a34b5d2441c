"""Source trees listed level by level (S1-S3), without what is ignored.

Each level is a table of folders. Tasks list the folders dealt to them through
the file system that the root's path names (local, HDFS, S3, GCS); ignored
folder names and patterns that cover a whole folder prune the next level, so an
ignored folder is never opened, however large. Files keep their sizes and times
from the listing; contents are read afterwards, dealt by size. Zero-byte files
are in the listing (``binaryFile`` leaves them out).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import paths as P
from quarry.operators.scan import ignored_dirs, read_text
from quarry.sinks.tables import write_snapshot
from quarry.sources.files import qualified
from quarry.sources.shared import file_system

#: Content that one reading task gets, about.
READ_BYTES = 64 << 20


def _list(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(root)
        for pdf in batches:
            rows = []
            for rel in pdf["path"]:
                for f in fs.get_file_info(pafs.FileSelector(f"{at}/{rel}".rstrip("/"))):
                    if f.type in (pafs.FileType.File, pafs.FileType.Directory):
                        ms = f.mtime_ns // 1_000_000 if f.mtime_ns is not None else None
                        rows.append((f"{rel}/{f.base_name}".lstrip("/"), f.type == pafs.FileType.Directory, f.size or 0, ms / 1e3 if ms is not None else None))
            yield pd.DataFrame(rows, columns=["path", "folder", "n_bytes", "mtime"])

    return run


def _covering(patterns: DataFrame | None) -> DataFrame | None:
    """Patterns that end in ``*``: one that matches ``folder/`` matches every
    file below it."""
    return None if patterns is None else patterns.where(F.col("pattern").endswith("*"))


def list_tree(spark: SparkSession, root: str, ignore: list[str] = K.INDEX_IGNORE_DIRS,
              patterns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(files, folders)`` under ``root``: files ``(path, n_bytes, mtime)``
    outside ignored folders, and the folders that were opened (``path``), with
    root-relative paths. ``patterns`` (F2) prune folders they cover whole; files
    are not tested against them here."""
    from quarry.operators.scan import drop_ignored

    at, covering = qualified(spark, root), _covering(patterns)
    level = spark.createDataFrame([("",)], "path string")
    files, opened = [], []
    while not level.isEmpty():
        opened.append(level)
        found = write_snapshot(level.repartition("path").mapInPandas(_list(at), "path string, folder boolean, n_bytes long, mtime double"), "listing")
        files.append(found.where("NOT folder").drop("folder"))
        level = ignored_dirs(found.where("folder").select("path"), ignore).where("NOT ignored").select("path")
        if covering is not None:
            below = level.withColumn("_below", F.concat("path", F.lit("/")))
            level = drop_ignored(below, covering, "_below").select("path")
        level = write_snapshot(level, "folders")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(files), union(opened)


def read_pruned_tree(spark: SparkSession, root: str, extensions: list[str] | None = K.INDEX_EXTENSIONS,
                     source: str | None = None, ignore: list[str] = K.INDEX_IGNORE_DIRS,
                     patterns: DataFrame | None = None) -> DataFrame:
    """The snapshot of ``read_tree`` without files in ignored folders, which are
    not even listed, and with zero-byte files. Files that cannot be read are
    left out."""
    at = qualified(spark, root)
    files, _ = list_tree(spark, root, ignore, patterns)
    if extensions:
        files = files.where(F.lower(P.suffix(F.col("path"))).isin(extensions))
    files = write_snapshot(files, "files")
    total = files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = file_system(at)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                try:
                    with fs.open_input_stream(f"{top}/{row.path}") as f:
                        yield pd.DataFrame({"path": [row.path], "mtime": [row.mtime], "content": [f.read()], "n_bytes": [row.n_bytes]})
                except OSError:
                    continue

    # dealt by a hash of the path: even in number, and the same on a retry
    raw = files.repartition(parts, "path").mapInPandas(read, "path string, mtime double, content binary, n_bytes long")
    return read_text(raw.withColumn("source", F.lit(source or root.rstrip("/").split("/")[-1])), "content")
