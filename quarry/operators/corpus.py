"""Per-file facts and per-root corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import paths as P
from quarry.operators.ordering import ordered_rank, ordered_windows
from quarry.operators.scan import language_map

FILE_HEADER = K.FILE_HEADER


def path_facts(files: DataFrame, root_col: str = "source") -> DataFrame:
    """Name, stem, lower-cased suffix and the path relative to its root."""
    p = F.col("path")
    return files.select(
        "path", P.name(p).alias("name"), P.stem(p).alias("stem"),
        F.lower(P.suffix(p)).alias("suffix"),
        F.expr(f"substring(path, length({root_col}) + 2)").alias("rel_path"),
    )


def sort_paths(files: DataFrame, root_col: str = "source") -> DataFrame:
    """Position of each path within its root in path-component order
    (``a/f`` before ``a-b/f``), and the plain string order for comparison."""
    by_parts = ordered_rank(files.select(root_col, "path").withColumn("_parts", P.parts(F.col("path"))),
                            [root_col], ["_parts", "path"], name="part_rank")
    by_string = ordered_rank(files.select(root_col, "path"), [root_col], ["path"], name="string_rank")
    return by_parts.drop("_parts").join(by_string, [root_col, "path"])


def language_of(files: DataFrame, framework: str | None = None) -> DataFrame:
    """Language and test framework by extension; ``Generic`` otherwise;
    an explicit framework wins."""
    lm = F.broadcast(language_map(files.sparkSession))
    f = files.withColumn("_ext", F.lower(P.suffix(F.col("path"))))
    j = f.join(lm, f["_ext"] == lm["ext"], "left")
    fw = F.lit(framework) if framework else F.coalesce(F.col("framework"), F.lit("generic"))
    return j.select(
        "path",
        F.coalesce(F.col("language"), F.lit(K.GENERIC_LANGUAGE)).alias("language"),
        fw.alias("framework"),
        F.col("prefix").alias("test_prefix"), F.col("suffix").alias("test_suffix"),
    )


def test_path(files: DataFrame) -> DataFrame:
    """Every ``src/`` becomes ``tests/``; the name becomes
    prefix + stem + suffix of the language, else stem + ``Test`` + extension."""
    return language_of(files).select("path", _test_path().alias("test_path"))


def _test_path() -> Column:
    p = F.col("path")
    moved = F.replace(p, F.lit("src/"), F.lit("tests/"))
    folder = F.regexp_extract(moved, r"^(.*/)[^/]*$", 1)
    new_name = F.when(F.col("test_suffix").isNotNull(),
                      F.concat(F.col("test_prefix"), P.stem(moved), F.col("test_suffix"))) \
        .otherwise(F.concat(P.stem(moved), F.lit("Test"), P.suffix(moved)))
    return F.concat(folder, new_name)


def test_targets(files: DataFrame) -> DataFrame:
    """T6 and T7 in one pass: ``path, test_path, language, framework``."""
    lang = language_of(files)
    return lang.select("path", _test_path().alias("test_path"), "language", "framework")


def dominant_language(files: DataFrame, root_col: str = "source") -> DataFrame:
    """A2: most frequent mapped language per root (ties: count desc, name
    asc); ``Generic`` when the root has no mapped file. No ignore set."""
    lm = F.broadcast(language_map(files.sparkSession).select("ext", "language"))
    f = files.select(root_col, F.lower(P.suffix(F.col("path"))).alias("ext"))
    counts = f.join(lm, "ext").groupBy(root_col, "language").agg(F.count(F.lit(1)).alias("n_files"))
    w = Window.partitionBy(root_col).orderBy(F.desc("n_files"), "language")
    top = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    roots = files.select(root_col).distinct()
    return roots.join(top, root_col, "left").select(
        root_col, F.coalesce("language", F.lit(K.GENERIC_LANGUAGE)).alias("language"),
        F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"))


def concat_corpus(files: DataFrame, root_col: str = "source",
                  limit: int = K.MAX_PAYLOAD_CHARS) -> DataFrame:
    """A3: per root, ``### File: path`` + content blocks joined by a blank line
    in path order: the whole text, as ``payload`` windows of ``limit``
    characters, with the root's ``n_files`` and ``total_chars``."""
    piece = F.concat(F.lit(FILE_HEADER), F.col("path"), F.lit("\n"), F.col("content"))
    rows = ordered_windows(files, [root_col], P.parts(F.col("path")), piece, "\n\n", limit)
    return rows.select(root_col, "window", "n_windows", F.col("n_rows").alias("n_files"), "total_chars", F.col("text").alias("payload"))


def doc_types(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, t, label) for i, (t, label) in enumerate(K.DOC_TYPES)],
        "type_order int, doc_type string, label string")


def doc_jobs(targets: DataFrame, out_dir: str = "docs") -> DataFrame:
    """G3 + T8: one job per target and document type, with its output path
    ``out_dir/type/stem.md``. The type list has 4 rows: a broadcast cross join."""
    t = F.broadcast(doc_types(targets.sparkSession))
    return targets.crossJoin(t).withColumn(
        "dest_path", F.concat_ws("/", F.lit(out_dir), F.col("doc_type"),
                                 F.concat(F.col("stem"), F.lit(".md"))))
