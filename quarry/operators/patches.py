"""Edit blocks in model answers: parse, target, apply in order.

Block format::

    <<<< SEARCH file:path/to/file
    lines to find
    ==== REPLACE
    new lines
    >>>>

Applying is a fold per ``(response_id, file)``: the patches of one answer for
one file, in block order, each seeing the previous result. The whole fold is
one SQL ``aggregate`` expression, so it runs inside the task that holds the
group - one file and one answer's blocks, both bounded. ``patch_snapshot`` folds
the blocks of all answers into one content per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import text as TX
from quarry.operators.ordering import ordered_rank
from quarry.sinks.tables import write_snapshot

BLOCK_RE = K.EDIT_BLOCK_RE
NOT_FOUND_FILE = "file not found: "
NOT_FOUND_TEXT = "search text not found in "


def parse_patches(df: DataFrame, key: str = "response_id", text_col: str = "text") -> DataFrame:
    """Every block (lazy, dot matches newline), numbered from 0 per answer;
    the file name is stripped."""
    # the text is matched once; the groups are then taken from each short block.
    # An inner explode would have Spark match again, in a filter for empty lists.
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(BLOCK_RE), 0)
    x = df.select(key, F.posexplode_outer(blocks).alias("patch_no", "_b")).where("patch_no IS NOT NULL")
    group = lambda i: F.regexp_extract("_b", BLOCK_RE, i)
    return x.select(key, F.col("patch_no").cast("int").alias("patch_no"), TX.py_strip(group(1)).alias("file"),
                    group(2).alias("search"), group(3).alias("replace"))


def preview_patch(patches: DataFrame) -> DataFrame:
    """First 500 characters of search and replacement for display."""
    return patches.select("response_id", "patch_no", "file",
                          F.substring("search", 1, K.PREVIEW_CHARS).alias("search_preview"),
                          F.substring("replace", 1, K.PREVIEW_CHARS).alias("replace_preview"))


def patch_targets(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Patch joined to its file; no match -> a not-found error."""
    f = files.select(F.col("path").alias("file"), F.col("content"))
    j = patches.join(f, "file", "left")
    return j.withColumn("found", F.col("content").isNotNull()).withColumn(
        "error", F.when(~F.col("found"), F.concat(F.lit(NOT_FOUND_FILE), F.col("file"))))


_BLANK = r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"  # white space that ends no line


def _normalized(c: Column) -> Column:
    """Every line right-stripped, joined by newlines (final newline dropped)."""
    last = F.regexp_replace(c, rf"(?:{_BLANK}*(?:{TX.LINE_BREAK})|{_BLANK}+)\z", "")
    return F.regexp_replace(last, rf"{_BLANK}*(?:{TX.LINE_BREAK})", "\n")


def _first_replace(content: Column, pos: Column, search: Column, repl: Column) -> Column:
    """Replace the occurrence of ``search`` at 1-based ``pos`` (first one)."""
    return F.overlay(content, repl, pos, F.length(search))


_RESULT = "array<struct<{0}patch_no:int,applied:boolean,error:string{1}>>"


def _fold(start: Column, patches: Column, id_type: str | None = None) -> Column:
    """Apply ordered patches to ``start`` (struct ``content``, ``file`` and, if
    patches of several answers meet, ``original``); a struct with the new
    content and ``res``, one result per patch."""
    own = id_type is not None  # results then name their answer, and conflicts

    def result(acc, p, applied: bool, error):
        fields = [p["patch_no"].alias("patch_no"), F.lit(applied).alias("applied"), error.cast("string").alias("error")]
        if own:
            was = F.lit(False) if applied else F.coalesce(F.position(p["search"], acc["original"]) > 0, F.lit(False))
            fields = [p["id"].alias("id"), *fields, was.alias("conflict")]
        return F.struct(*fields)

    def state(content, acc, p, applied, error):
        kept = [acc["original"].alias("original")] if own else []
        return F.struct(content.alias("content"), acc["file"].alias("file"), *kept,
                        F.array_append(acc["res"], result(acc, p, applied, error)).alias("res"))

    def merge(acc, p):
        content = acc["content"]
        exact = F.position(p["search"], content)

        def fallback(x):  # x binds both normalised texts once for this step
            npos = F.position(x["s"], x["n"])
            return F.when(npos > 0, state(_first_replace(x["n"], npos, x["s"], p["replace"]), acc, p, True,
                                          F.lit(None))) \
                .otherwise(state(content, acc, p, False, F.concat(F.lit(NOT_FOUND_TEXT), acc["file"])))

        bound = F.transform(F.array(F.struct(_normalized(content).alias("n"),
                                             _normalized(p["search"]).alias("s"))), fallback)
        return (F.when(content.isNull(),
                       state(content, acc, p, False, F.concat(F.lit(NOT_FOUND_FILE), acc["file"])))
                .when(exact > 0, state(_first_replace(content, exact, p["search"], p["replace"]), acc, p,
                                       True, F.lit(None)))
                .otherwise(F.element_at(bound, 1)))

    empty = F.array().cast(_RESULT.format(f"id:{id_type}," if own else "", ",conflict:boolean" if own else ""))
    names = ["content", "file"] + ["original"] * own
    init = F.struct(*[start[n].alias(n) for n in names], empty.alias("res"))
    return F.aggregate(patches, init, merge)


def _by_file(patches: DataFrame) -> DataFrame:
    """Patches dealt by file, which is what they are grouped and joined by. The
    number of partitions is stated, as folding takes long for its bytes: Spark
    would join small partitions to few tasks."""
    return patches.repartition(int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def apply_patches(patches: DataFrame, files: DataFrame, key: str = "response_id") -> DataFrame:
    """Fold the patches of each (answer, file) in order. The patches are
    grouped first, so a file's text joins its group once, not each patch.

    Exact match replaces the first occurrence. Otherwise the right-stripped
    forms are compared and, on a match, the normalised text is written. A
    missing file (NULL content) records its not-found error for every patch.
    Returns ``(response_id, file, content, results)`` with ``results`` an
    ``array<struct<patch_no, applied, error>>`` in patch order; ``content`` is
    NULL for missing files.
    """
    grouped = _by_file(patches).groupBy(key, "file").agg(
        F.array_sort(F.collect_list(F.struct("patch_no", "search", "replace"))).alias("_p"))
    grouped = grouped.join(files.select(F.col("path").alias("file"), "content"), "file", "left")
    folded = grouped.select(key, "file", _fold(F.struct("content", "file"), F.col("_p")).alias("_f"))
    return folded.select(key, "file", F.col("_f.content").alias("content"), F.col("_f.res").alias("results"))


#: Patches of one file folded in one round of ``patch_snapshot``: what a task
#: holds for a file, however many answers edit it.
PATCHES_PER_ROUND = 1000


def patch_snapshot(patches: DataFrame, files: DataFrame, key: str = "response_id",
                   per_round: int = PATCHES_PER_ROUND) -> tuple[DataFrame, DataFrame]:
    """C12 over many answers: ``(snapshot, results)``.

    The patches of all answers to a file are applied to it one after the other,
    by answer and then by block, each seeing what the earlier ones wrote.
    ``snapshot`` has one row ``(path, content, n_applied, n_failed)`` per file,
    files that no patch names included; ``results`` one row ``(response_id,
    patch_no, file, applied, error, conflict)`` per patch, where ``conflict``
    marks a text that was not found because an earlier patch had changed it.
    Patches of missing files have a result and no file. Files are read once per
    round; a round folds up to ``per_round`` patches of each file.
    """
    id_type = patches.schema[key].dataType.simpleString()
    turn = ordered_rank(patches.select("file", F.col(key).alias("id"), "patch_no"), ["file"], ["id", "patch_no"], "turn")
    rows = patches.withColumnRenamed(key, "id").join(turn, ["file", "id", "patch_no"])
    rows = rows.withColumn("round", F.floor((F.col("turn") - 1) / per_round).cast("int"))
    grouped = rows.groupBy("file", "round").agg(F.array_sort(F.collect_list(F.struct("id", "patch_no", "search", "replace"))).alias("_p"))
    grouped = write_snapshot(grouped, "patch-rounds")
    last = grouped.agg(F.coalesce(F.max("round"), F.lit(-1))).first()[0]
    state = files.select(F.col("path").alias("file"), "content", F.col("content").alias("original"))
    done, results = [], []
    for r in range(last + 1):
        mine = _by_file(grouped.where(F.col("round") == r).select("file", "_p"))
        start = F.struct("content", "file", "original")
        folded = mine.join(state, "file", "left").select("file", "original", _fold(start, F.col("_p"), id_type).alias("_f"))
        folded = write_snapshot(folded.select("file", "original", F.col("_f.content").alias("content"), F.col("_f.res").alias("res")), "patched")
        results.append(folded.select("file", F.explode_outer("res").alias("r")))
        done.append(folded.select("file", "content", F.lit(r).alias("round")))
        state = folded.select("file", "content", "original")
    if not done:
        none = patches.where("false").select(key, "patch_no", "file", F.lit(True).alias("applied"), F.lit("").alias("error"), F.lit(False).alias("conflict"))
        return files.select("path", "content", F.lit(0).cast("long").alias("n_applied"), F.lit(0).cast("long").alias("n_failed")), none
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    out = out.select(F.col("r.id").alias(key), "r.patch_no", "file", "r.applied", "r.error", "r.conflict")
    latest = done[0]
    for x in done[1:]:
        latest = latest.unionByName(x)
    latest = latest.groupBy("file").agg(F.max("round").alias("round")).join(latest, ["file", "round"])
    counts = out.groupBy("file").agg(F.count_if("applied").alias("n_applied"), F.count_if(~F.col("applied")).alias("n_failed"))
    new = latest.join(counts, "file").select(F.col("file").alias("path"), F.col("content").alias("new"), "n_applied", "n_failed")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    snapshot = files.select("path", "content").join(new, "path", "left").select(
        "path", F.coalesce("new", "content").alias("content"), zero("n_applied"), zero("n_failed"))
    return snapshot, out


def patch_results(applied: DataFrame, key: str = "response_id") -> DataFrame:
    """Per patch: ``applied`` and ``error``. (Every group has results. An inner
    explode would have Spark fold again, in a filter for empty lists.)"""
    return applied.select(key, F.explode_outer("results").alias("r")).select(
        key, F.col("r.patch_no").alias("patch_no"), F.col("r.applied").alias("applied"),
        F.col("r.error").alias("error"))


def patch_summary(results: DataFrame, key: str = "response_id") -> DataFrame:
    """Total and applied patches per answer."""
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("total"),
                                    F.count_if(F.col("applied")).alias("applied"))
