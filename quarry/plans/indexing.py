"""Index lifecycle jobs: build (C1), update (C2), retrieve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions.embed import hashed_embedding
from quarry.operators import index_ops as IX
from quarry.operators.chunking import chunk_text
from quarry.operators.knn import knn
from quarry.operators.knn_join import knn_join
from quarry.operators.scan import scan_index_files
from quarry.sinks.tables import write_snapshot
from quarry.sinks.vector_cache import VectorCache


def widen(df: DataFrame) -> DataFrame:
    """Spread a snapshot read from few splits over every core before the
    CPU-heavy chunk/embed step. A no-op when the input already has at least
    ``defaultParallelism`` partitions (the normal case on a cluster)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    # hash on the unique path: even, and deterministic on retry (no round-robin sort)
    return df.repartition(par, "path") if df.rdd.getNumPartitions() < par else df


def index_rows(files: DataFrame, dim: int = K.EMBED_DIM, embed=None, patterns: DataFrame | None = None,
               root_col: str | None = None) -> DataFrame:
    """S1 (with F2) -> G1 -> E1 over a file snapshot ``(path, mtime, content)``.

    Chunks are produced where their file was read (narrow explode); the scan
    already balances partitions by bytes, and chunk count follows bytes.
    ``embed`` is a function of the text column, or a ``VectorCache``, which
    embeds each distinct text once.
    """
    f = widen(scan_index_files(files, patterns=patterns, root_col=root_col).select("path", "mtime", "content"))
    chunks = chunk_text(f, "content", keep=["path", "mtime"]).select(
        F.col("path").alias("file"), "chunk_index", "text", F.col("mtime").cast("double").alias("mtime"))
    if isinstance(embed, VectorCache):
        return embed.vectors(chunks, F.col("text"))
    vec = embed(F.col("text")) if embed is not None else hashed_embedding(F.col("text"), dim)
    return chunks.withColumn("embedding", vec)


def build_index(files: DataFrame, dim: int = K.EMBED_DIM, embed=None, patterns: DataFrame | None = None,
                root_col: str | None = None) -> DataFrame:
    """The full index of a snapshot (an empty frame when nothing
    qualifies). Files that an ignore pattern matches are left out (F2)."""
    return index_rows(files, dim, embed, patterns, root_col)


def index_delta(old: DataFrame, files: DataFrame, dim: int = K.EMBED_DIM, embed=None,
                patterns: DataFrame | None = None, root_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """C2 as a change of the stored index: ``(rows, removed)``, the rows of new
    and strictly newer files and the ``file`` names whose earlier rows no
    longer count. Status is resolved on (path, mtime); of the index only these
    two columns are read, and no row of an unchanged file is written."""
    current = scan_index_files(files, patterns=patterns, root_col=root_col).select("path", "mtime", "content")
    status = IX.file_status(old.select("file", "mtime"), current)
    todo = status.where(F.col("status").isin("new", "changed")).select(F.col("file").alias("path"))
    rows = index_rows(current.join(todo, "path", "left_semi"), dim, embed)
    return rows, status.where(F.col("status").isin("deleted", "changed", "new")).select("file")


def changes_to_delta(old: DataFrame, changes: DataFrame, dim: int = K.EMBED_DIM, embed=None,
                     patterns: DataFrame | None = None, root_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """X3's step: ``(rows, removed)`` for change rows ``(path, mtime, content,
    op)``. Files that no row names keep their rows. Of several changes of one
    file the newest counts; a put that is not newer than the index changes
    nothing; a delete removes the file."""
    order = F.struct(F.coalesce("mtime", F.lit(float("inf"))), F.col("op") == "delete")
    newest = changes.groupBy("path").agg(F.max_by(F.struct("mtime", "content", "op"), order).alias("c")).select("path", "c.*")
    puts = scan_index_files(newest.where("op = 'put'"), patterns=patterns, root_col=root_col)
    named = old.select("file", "mtime").join(newest.select(F.col("path").alias("file")), "file", "left_semi")
    todo = IX.file_status(named, puts).where(F.col("status").isin("new", "changed")).select("file")
    rows = index_rows(puts.join(todo.withColumnRenamed("file", "path"), "path", "left_semi"), dim, embed)
    # a file that is put but no longer qualifies (moved under an ignore pattern) is removed too
    out = newest.join(puts.select("path"), "path", "left_anti").select(F.col("path").alias("file"))
    return rows, todo.union(out)


def update_index(old: DataFrame, files: DataFrame, dim: int = K.EMBED_DIM, embed=None,
                 patterns: DataFrame | None = None, root_col: str | None = None):
    """``(new_index, stats)``.

    Unchanged files keep their rows and vectors (semi join); new or strictly
    newer files are re-chunked and re-embedded; deleted files and files that an
    ignore pattern now matches drop out. ``index_delta`` gives the same update
    as a delta for ``IndexStore.save_delta``.
    """
    current = scan_index_files(files, patterns=patterns, root_col=root_col).select("path", "mtime", "content")
    status = IX.file_status(old, current)
    kept = old.join(status.where(F.col("status") == "unchanged").select("file"), "file", "left_semi")
    todo = status.where(F.col("status").isin("new", "changed")).select(F.col("file").alias("path"))
    changed = current.join(todo, "path", "left_semi")
    new = index_rows(changed, dim, embed)
    merged = IX.merge_index(kept, new.select(*kept.columns))
    return merged, IX.index_stats(old, kept, new)


def embed_queries(queries: DataFrame, text_col: str = "text", dim: int = K.EMBED_DIM,
                  embed=None, keep: tuple[str, ...] = ()) -> DataFrame:
    if isinstance(embed, VectorCache):
        return embed.vectors(queries.select("query_id", *keep, F.col(text_col).alias("_asked")), F.col("_asked")).drop("_asked")
    vec = embed(F.col(text_col)) if embed is not None else hashed_embedding(F.col(text_col), dim)
    return queries.select("query_id", *keep, vec.alias("embedding"))


def root_of(path: Column) -> Column:
    """The root of a file of a snapshot that holds several: its first folder."""
    return F.substring_index(path, "/", 1)


def retrieve(index: DataFrame, queries: DataFrame, k: int = K.TOP_K,
             text_col: str = "text", dim: int = K.EMBED_DIM, embed=None, index_root: Column | None = None,
             files_of=None) -> DataFrame:
    """E1 on the questions -> J1 -> J2 -> T9.

    ``hits(query_id, rank, file, chunk_index, text, distance, score)``. With
    ``index_root`` (an expression over the index, e.g. ``root_of("file")``)
    each query is answered from the files of its own ``root`` only. ``files_of``
    gives the index rows of named files (``IndexStore.load_files``), so that
    texts are read for the hits' files only; the hits are written then.
    """
    keys = ["file", "chunk_index"]
    if index_root is None:
        hits = knn(index, embed_queries(queries, text_col, dim, embed), k, keys)
    else:
        hits = knn_join(index, embed_queries(queries, text_col, dim, embed, ("root",)), k, keys,
                        corpus_group=index_root, query_group=F.col("root"))
    if files_of is not None:
        hits = write_snapshot(hits, "hits")
        index = files_of(hits.select("file"))
    joined = index.select(*keys, "text").join(hits, keys, "inner")
    return joined.select(
        "query_id", "rank", "file", "chunk_index", "text", "distance",
        F.format_string("%.4f", F.col("distance")).alias("score"),
    )
