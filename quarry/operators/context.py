"""Retrieval context and prompt budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import paths as P
from quarry.functions import text as TX
from quarry.operators.ordering import ordered_windows
from quarry.sinks.tables import write_snapshot

FAILED_SUMMARY = K.FAILED_SUMMARY


def _block(scored: bool) -> Column:
    """FIXED FORMAT (A4): ``--- Chunk {i} (file: {file}) ---`` or, scored,
    ``--- Chunk {i} (file: {file}, score: {score}) ---``, then the text."""
    head = [F.lit("--- Chunk "), F.col("rank").cast("string"), F.lit(" (file: "), F.col("file")]
    if scored:
        head += [F.lit(", score: "), F.col("score")]
    return F.concat(*head, F.lit(") ---\n"), F.col("text"))


def context_block(hits: DataFrame) -> DataFrame:
    """A4: per query, numbered chunk blocks joined by a blank line in rank
    order, plain and with scores. At most k rows per query."""
    b = hits.select("query_id", "rank", _block(False).alias("_b"), _block(True).alias("_s"))
    order = lambda c: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", c))), lambda s: s[c]), "\n\n")
    return b.groupBy("query_id").agg(order("_b").alias("context"), order("_s").alias("scored_context"))


def retrieval_queries(df: DataFrame, text_col: str = "content", path_col: str = "path") -> DataFrame:
    """T5: the search text used by review, audit and test generation."""
    t = F.col(text_col)
    head = F.substring(t, 1, K.QUERY_PREFIX_CHARS)
    return df.select(
        path_col,
        F.concat(F.lit(K.REVIEW_QUERY_PREFIX), head).alias("review_query"),
        F.concat(F.lit(K.AUDIT_QUERY_PREFIX), TX.py_strip(F.replace(head, F.lit("\n"), F.lit(" "))))
        .alias("audit_query"),
        F.concat(F.lit(K.TESTS_QUERY_PREFIX), P.name(F.col(path_col))).alias("tests_query"),
    )


def probe_queries(spark: SparkSession) -> DataFrame:
    """The fixed probe texts as a query table (probe order = query_id)."""
    return spark.createDataFrame([(i, p) for i, p in enumerate(K.PROBES)], "query_id int, text string")


def dedup_hits(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Across probes in probe order then rank, the first hit per first 100
    characters of text (and per ``by``). At most probes x k rows each."""
    key = F.substring("text", 1, K.DEDUP_PREFIX_CHARS)
    w = Window.partitionBy(*by or [], key).orderBy("query_id", "rank")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def summary_piece(rel: Column, summary: Column) -> Column:
    ok = summary.isNotNull() & (F.length(summary) > 0)
    return F.concat(F.lit("### "), rel, F.lit("\n"), F.when(ok, summary).otherwise(F.lit(FAILED_SUMMARY)))


def budget_chars(num_ctx: int = K.DEFAULT_NUM_CTX) -> int:
    return num_ctx * K.CHARS_PER_TOKEN


def _summary_text(label_col: str) -> Column:
    return summary_piece(F.col(label_col), F.col("summary"))


def file_tree(files: DataFrame, root_col: str = "source", rel_col: str = "rel_path",
              limit: int | DataFrame | None = None) -> DataFrame:
    """Per root, relative paths in path-component order joined by newlines,
    as ``tree`` windows of ``limit`` characters (default: the prompt budget),
    with ``tree_files`` and ``tree_chars`` of the whole list."""
    rows = ordered_windows(files, [root_col], P.parts(F.col(rel_col)), F.col(rel_col), "\n",
                           budget_chars() if limit is None else limit)
    return rows.select(root_col, "window", "n_windows", F.col("n_rows").alias("tree_files"),
                       F.col("total_chars").alias("tree_chars"), F.col("text").alias("tree"))


def summaries_concat(summaries: DataFrame, root_col: str = "source", rel_col: str = "rel_path",
                     limit: int | DataFrame | None = None, label_col: str | None = None) -> DataFrame:
    """Per root, ``### path`` + summary blocks (failure text for a missing
    summary) joined by blank lines in path order, as ``summaries`` windows.
    ``label_col`` names another column for the headings."""
    rows = ordered_windows(summaries, [root_col], P.parts(F.col(rel_col)), _summary_text(label_col or rel_col), "\n\n",
                           budget_chars() if limit is None else limit)
    return rows.select(root_col, "window", "n_windows", F.col("n_rows").alias("n_summaries"),
                       F.col("total_chars").alias("summaries_chars"), F.col("text").alias("summaries"))


def _joined_chars(df: DataFrame, root_col: str, piece: Column, sep: str, name: str) -> DataFrame:
    return df.groupBy(root_col).agg((F.sum(F.length(piece) + len(sep)) - len(sep)).alias(name))


def budget_prompt(files: DataFrame, summaries: DataFrame, root_col: str = "source", rel_col: str = "rel_path",
                  num_ctx: int = K.DEFAULT_NUM_CTX, label_col: str | None = None) -> DataFrame:
    """T4: the tree (A8) and the summaries (A7) of each root, fitted to
    prompts of ``num_ctx * 3`` characters.

    When both fit, one row holds both. Otherwise a prompt has
    ``min(tree, budget // 4)`` characters of the tree and the rest of the
    budget of the summaries; what does not fit goes into further prompts
    (``window`` 0 to ``n_windows - 1``), and every part that goes on in the
    next prompt ends in a marker.
    """
    budget = budget_chars(num_ctx)
    sizes = _joined_chars(files, root_col, F.col(rel_col), "\n", "tree_chars") \
        .join(_joined_chars(summaries, root_col, _summary_text(label_col or rel_col), "\n\n", "summaries_chars"), root_col)
    cut = F.col("tree_chars") + F.col("summaries_chars") > budget
    of_tree = F.least(F.col("tree_chars"), F.lit(budget // 4))
    sizes = sizes.select(root_col, "tree_chars", "summaries_chars", cut.alias("cut"),
                         F.greatest(F.when(cut, of_tree).otherwise(F.col("tree_chars")), F.lit(1)).alias("_t"),
                         F.greatest(F.when(cut, budget - of_tree).otherwise(F.col("summaries_chars")), F.lit(1)).alias("_s"))
    # the number of prompts follows from the sizes, so no window looks at texts
    n = F.greatest(F.ceil(F.col("tree_chars") / F.col("_t")), F.ceil(F.col("summaries_chars") / F.col("_s")))
    sizes = write_snapshot(sizes.withColumn("n_windows", n), "budget")
    tree = file_tree(files, root_col, rel_col, sizes.select(root_col, F.col("_t").alias("limit"))) \
        .select(root_col, "window", F.col("n_windows").alias("_nt"), "tree")
    summ = summaries_concat(summaries, root_col, rel_col, sizes.select(root_col, F.col("_s").alias("limit")), label_col) \
        .select(root_col, "window", F.col("n_windows").alias("_ns"), "summaries")
    both = tree.join(summ, [root_col, "window"], "full_outer").join(sizes.select(root_col, "cut", "n_windows"), root_col)
    marked = lambda text, count: F.when(F.col("window") < F.col(count) - 1, F.concat(F.col(text), F.lit(K.TRUNCATED_MARKER))) \
        .otherwise(F.coalesce(F.col(text), F.lit("")))
    return both.select(root_col, "window", "n_windows", marked("tree", "_nt").alias("tree"),
                       marked("summaries", "_ns").alias("summaries"), "cut")
