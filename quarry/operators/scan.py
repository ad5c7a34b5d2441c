"""File selection: ignore folders, extension lists, ignore patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry import constants as K
from quarry.functions import paths as P
from quarry.functions import text as TX


def ignored_dirs(df: DataFrame, names: list[str] = K.INDEX_IGNORE_DIRS,
                 path_col: str = "path") -> DataFrame:
    """rows with a flag ``ignored`` = some path component is in ``names``."""
    return df.withColumn("ignored", P.has_part_in(F.col(path_col), names))


def _ext_filter(df: DataFrame, exts: list[str], ignore: list[str], path_col: str) -> DataFrame:
    path = F.col(path_col)
    return df.where(~P.has_part_in(path, ignore) & F.lower(P.suffix(path)).isin(exts))


def scan_index_files(files: DataFrame, path_col: str = "path", patterns: DataFrame | None = None,
                     root_col: str | None = None) -> DataFrame:
    """Files the index covers (13 ignored folder names, 21 extensions) and
    no ignore pattern matches (a global list, or per root with ``root_col``)."""
    found = _ext_filter(files, K.INDEX_EXTENSIONS, K.INDEX_IGNORE_DIRS, path_col)
    return found if patterns is None else drop_ignored(found, patterns, path_col, root_col)


def scan_code_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files the code collectors read (11 ignored folder names, 16 extensions)."""
    return _ext_filter(files, K.CODE_EXTENSIONS, K.CODE_IGNORE_DIRS, path_col)


def language_map(spark: SparkSession) -> DataFrame:
    """The 6-row extension map as a DataFrame (always broadcast: fixed size)."""
    return spark.createDataFrame(
        K.LANGUAGE_MAP, "ext string, language string, framework string, prefix string, suffix string")


def _class_regex(body: str) -> str:
    """Regex of a bracket class. ``!`` negates, ``a-z`` is a range (one that
    runs backwards holds nothing), any other character stands for itself."""
    negated = body.startswith("!")
    chars, i, parts = body[negated:], 0, []
    quote = lambda c: "\\" + c if c in "\\[]^&-" else c
    while i < len(chars):
        if chars[i + 1 : i + 2] == "-" and i + 2 < len(chars):
            if chars[i] <= chars[i + 2]:
                parts.append(f"{quote(chars[i])}-{quote(chars[i + 2])}")
            i += 3
        else:
            parts.append(quote(chars[i]))
            i += 1
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def glob_regex(pattern: str) -> str:
    """Glob to anchored regex: ``*`` any run (crossing ``/``), ``?`` one char,
    ``[...]`` a class; a bracket that is never closed is literal, and so is
    everything else."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        # a class has at least one character: "]" right after "[" or "[!" is one
        close = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if close > 0:
            out.append(_class_regex(pattern[i + 1 : close]))
            i = close
        else:
            out.append({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "_/ " or ord(c) > 127 else "\\" + c))
        i += 1
    return "^(?s:" + "".join(out) + r")\z"


@F.pandas_udf(StringType())
def pattern_regex(patterns: pd.Series) -> pd.Series:
    """``glob_regex`` over pattern rows, which are few."""
    return patterns.map(glob_regex, na_action="ignore")


def _kind(pattern: Column) -> Column:
    """``kind`` and ``literal`` of a pattern: plain text (exact), ``*text``
    (suffix), ``text*`` (prefix), or anything else (regex)."""
    plain = lambda c: (F.length(c) > 0) & ~c.rlike(r"[*?\[]")
    rest, head = F.substr(pattern, F.lit(2)), F.substr(pattern, F.lit(1), F.length(pattern) - 1)
    made = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("literal"))
    return (F.when(plain(pattern), made("exact", pattern)).when(pattern.startswith("*") & plain(rest), made("suffix", rest))
            .when(pattern.endswith("*") & plain(head), made("prefix", head)).otherwise(made("regex", F.lit(None).cast("string"))))


def ignore_patterns(spark: SparkSession, lines: DataFrame, line_col: str = "line",
                    keep: list[str] | None = None) -> DataFrame:
    """pattern lines -> ``(keep..., pattern, regex, kind, literal)``; blank
    and ``#`` lines dropped."""
    keep = list(keep or [])
    p = TX.py_strip(F.col(line_col))
    found = lines.select(*keep, p.alias("pattern")).where((F.length("pattern") > 0) & ~F.col("pattern").startswith("#")).distinct()
    found = found.withColumn("_k", _kind(F.col("pattern")))
    return found.select(*keep, "pattern", pattern_regex(F.col("pattern")).alias("regex"), "_k.kind", "_k.literal")


#: Up to this many patterns of a global list are collected and become sets of
#: literals in a filter; a longer list is joined by its literals.
MAX_GLOBAL_PATTERNS = 200_000
#: Patterns that are neither text, suffix nor prefix, in one alternation.
MAX_REGEXES = 10_000


def _names_of(path: Column) -> list[Column]:
    """What a pattern is tested on."""
    return [path, P.name(path), F.concat(path, F.lit("/"))]


def _matches(path_col: str, regex: Column) -> Column:
    hits = [F.rlike(n, regex) for n in _names_of(F.col(path_col))]
    return hits[0] | hits[1] | hits[2]


def _cut(name: Column, kind: str, n: int) -> Column:
    """The part of a name that a literal of ``n`` characters would equal."""
    return F.when(F.length(name) >= n, F.substr(name, F.lit(1), F.lit(n)) if kind == "prefix" else F.right(name, F.lit(n)))


def drop_ignored(files: DataFrame, patterns: DataFrame, path_col: str = "path",
                 root_col: str | None = None) -> DataFrame:
    """files no pattern matches (relative path, bare name, or path + '/').

    A global list is an index: texts, suffixes and prefixes are hash sets that a
    path, its name, and their ends of the lengths that occur are looked up in;
    only the other patterns are tested one by one, as an alternation. Up to
    ``MAX_GLOBAL_PATTERNS`` the sets are literals of a plain filter, compiled
    once per task, no join; beyond, they stay a table and are equi-joined.
    Per-root lists (``root_col`` in both frames) are combined per root and
    equi-joined on the root; rows reach the filter grouped by root, so each
    root's regex is compiled once per run.
    """
    if root_col is None:
        return _drop_globally(files, patterns, path_col)
    per_root = patterns.groupBy(F.col(root_col).alias("_root")).agg(
        F.array_join(F.array_sort(F.collect_set("regex")), "|").alias("_rx"))
    j = files.join(per_root, files[root_col] == per_root["_root"], "left")
    keep = F.col("_rx").isNull() | ~_matches(path_col, F.col("_rx"))
    return j.where(keep).drop("_root", "_rx")


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _drop_globally(files: DataFrame, patterns: DataFrame, path_col: str) -> DataFrame:
    names = _names_of(F.col(path_col))
    short = patterns.select("kind", "literal", "regex").limit(MAX_GLOBAL_PATTERNS + 1).collect()
    if len(short) <= MAX_GLOBAL_PATTERNS:
        sets: dict[tuple[str, int], set[str]] = {}
        for r in short:
            if r.kind != "regex":
                sets.setdefault((r.kind, 0 if r.kind == "exact" else len(r.literal)), set()).add(r.literal)
        if sets:
            part = {"exact": "n", "prefix": "left(n, {0})", "suffix": "right(n, {0})"}
            hits = [f"exists(_names, n -> {part[kind].format(n)} IN ({', '.join(map(_sql_text, sorted(literals)))}))" for (kind, n), literals in sorted(sets.items())]
            files = files.withColumn("_names", F.array(*names)).where(F.expr(f"NOT coalesce({' OR '.join(hits)}, false)")).drop("_names")
        regexes = sorted({r.regex for r in short if r.kind == "regex"})
    else:
        literals = patterns.where("kind <> 'regex'").select("kind", "literal").distinct()
        lengths = literals.where("kind <> 'exact'").select("kind", F.length("literal").alias("n")).distinct().collect()
        key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("literal"))
        keys = F.array(*[key("exact", n) for n in names], *[key(r.kind, _cut(n, r.kind, r.n)) for r in lengths for n in names])
        asked = files.select(F.col(path_col).alias("_path"), F.explode(F.array_distinct(keys)).alias("_k")).select("_path", "_k.*")
        hit = asked.join(literals, ["kind", "literal"]).select("_path").distinct()
        files = files.join(hit, F.col(path_col) == F.col("_path"), "left_anti")
        regexes = sorted(r["regex"] for r in patterns.where("kind = 'regex'").select("regex").distinct().toLocalIterator())
    for i in range(0, len(regexes), MAX_REGEXES):
        files = files.where(~_matches(path_col, F.lit("|".join(regexes[i : i + MAX_REGEXES]))))
    return files


def read_ignore_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Ignore-file lines as ``(root, line)``, ``root`` = the folder holding the file.

    Spark's file sources skip hidden names such as ``.gitignore``, so the tasks
    read the files through the file system that their URI names (local paths,
    HDFS, object stores). A missing file contributes no lines; one that can't
    be read is an error.
    """
    listing = spark.createDataFrame([(p,) for p in paths], "path string")

    def read(batches):
        import os

        from pyarrow import fs as pafs

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                root = os.path.basename(os.path.dirname(p.rstrip("/")))
                fs, name = pafs.FileSystem.from_uri(p if "://" in p else os.path.abspath(p))
                if fs.get_file_info(name).type == pafs.FileType.NotFound:
                    continue
                with fs.open_input_stream(name) as fh:
                    rows.extend((root, line) for line in fh.read().decode("utf-8", "replace").splitlines())
            yield pd.DataFrame(rows, columns=["root", "line"])

    return listing.mapInPandas(read, "root string, line string")


def scan_mapped_files(files: DataFrame, patterns: DataFrame | None = None,
                      path_col: str = "path", root_col: str | None = None) -> DataFrame:
    """S3: files with one of the 6 mapped extensions, outside ignored folders and
    not matched by an ignore pattern (a global list, or per root with ``root_col``)."""
    spark = files.sparkSession
    lm = language_map(spark).select("ext")
    base = files.where(~P.has_part_in(F.col(path_col), K.CODE_IGNORE_DIRS)) \
        .withColumn("_ext", F.lower(P.suffix(F.col(path_col))))
    base = base.join(F.broadcast(lm), base["_ext"] == lm["ext"], "left_semi").drop("_ext")
    if patterns is not None:
        base = drop_ignored(base, patterns, path_col, root_col)
    return base


def read_text(df: DataFrame, bytes_col: str = "content") -> DataFrame:
    """Bytes -> text; malformed UTF-8 -> U+FFFD; ``\\r\\n`` / ``\\r`` -> ``\\n``."""
    c = F.col(bytes_col)
    return df.withColumn(bytes_col, TX.normalize_newlines(F.make_valid_utf8(c.cast("string"))))


def drop_blank(df: DataFrame, text_col: str = "content") -> DataFrame:
    """keep rows whose stripped text is non-empty."""
    return df.where(~TX.is_blank(F.col(text_col)))


def oversized(df: DataFrame, text_col: str = "content") -> DataFrame:
    """flag ``oversized`` = longer than 15,000 characters."""
    return df.withColumn("oversized", F.length(text_col) > K.MAX_PAYLOAD_CHARS)


# A line is suppressed when it ends in a comment naming an ``ignore-sec`` tag,
# for example ``# mytool-ignore-sec`` or ``// mytool-ignore-sec``.
SUPPRESS_RE = r"(?://|#)\s*[\w.-]*ignore-sec\s*$"


def suppress_lines(df: DataFrame, text_col: str = "content") -> DataFrame:
    """drop lines that carry a suppression comment; other lines unchanged."""
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda l: ~l.rlike(SUPPRESS_RE))
    return df.withColumn(text_col, F.array_join(kept, "\n"))
