"""Views derived from the driver tables, shaped like the engine's inputs.

The engine works on file snapshots, model token streams and model answers.
The driver tables hold documents and conversations, so these views map them
onto those shapes with plain projections; each has an identical SQL form in
``quarry.checks.oracle`` so both engines see the same inputs.

* ``files_base``  - one file per document under ``source/DIR/f{doc_id}EXT``.
* ``files_head``  - a later snapshot: deleted, changed, back-dated and new files.
* ``tokens``      - assistant turns cut into 20-character stream pieces with
                    reasoning tags injected by ``conv_id % 5``.
* ``patch_responses`` - one model answer per document with two edit blocks.
* ``patch_files`` - the files those edit blocks target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.operators.generate import Scripted, default_answer
from quarry.sources.tables import table

# Directory and extension cycles used to spread documents over a source tree
# (covers ignored folders, unlisted and upper-case extensions).
DIRS = ["src", "lib", "vendor", "app", "build", "src/core", "docs"]
EXTS = [".py", ".PHP", ".cs", ".ts", ".js", ".kt", ".md", ".txt", ".json"]
BASE_MTIME = 1700000000
NEW_FILE_MTIME = 1800000000
TOKEN_PIECE = 20
FIRST_REPLACEMENT = "patched = True"
SECOND_REPLACEMENT = "patched_twice = True\nassert patched_twice"
THIRD_REPLACEMENT = "patched_thrice = True"
SECOND_ANSWERS_FROM = 1_000_000_000_000


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def files_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(
        d.source, F.lit("/"), _pick(DIRS, d.doc_id % 7), F.lit("/f"),
        d.doc_id.cast("string"), _pick(EXTS, d.doc_id % 9),
    )
    return d.select(
        path.alias("path"),
        (F.lit(BASE_MTIME) + d.doc_id).cast("double").alias("mtime"),
        d.text.alias("content"),
        d.source,
        d.doc_id,
    )


def files_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = files_base(spark, sf_dir).where(F.col("doc_id") % 10 != 0)
    m = F.col("doc_id") % 10
    changed = F.concat(F.col("content"), F.lit(" changed"))
    head = base.select(
        "path",
        F.when(m == 1, F.col("mtime") + 1).when(m == 2, F.col("mtime") - 1)
        .otherwise(F.col("mtime")).alias("mtime"),
        F.when(m.isin(1, 2), changed).otherwise(F.col("content")).alias("content"),
        "source",
        "doc_id",
    )
    b = table(spark, sf_dir, "benchmark")
    new = b.select(
        F.concat(F.lit("bench/b"), b.item_id.cast("string"), F.lit(".py")).alias("path"),
        F.lit(float(NEW_FILE_MTIME)).alias("mtime"),
        b.text.alias("content"),
        F.lit("bench").alias("source"),
        F.lit(None).cast("bigint").alias("doc_id"),
    )
    return head.unionByName(new)


SCRIPT_FINDINGS = "[High] - [app.py:1] - [input is not checked] - [check it]\nlow | b.py | old call | new call\n"
SCRIPT_BLOCK = "\n<<<< SEARCH file:a.py\nold\n==== REPLACE\nnew\n>>>>\n"


def scripted() -> Scripted:
    """Answers of every kind a job must tell apart, chosen by the length of
    the prompt: empty, NULL, all-clear, findings, with reasoning, with an edit
    block, reasoning that never ends, plain."""
    def answer(user: Column) -> Column:
        plain = default_answer(user)
        kinds = [F.lit(""), F.lit(None).cast("string"), F.concat(plain, F.lit("\n" + K.ALL_CLEAR_SENTINEL)),
                 F.concat(F.lit(SCRIPT_FINDINGS), plain), F.concat(F.lit("<think>first\n"), F.substring(plain, 1, 20), F.lit("</think>"), plain),
                 F.concat(plain, F.lit(SCRIPT_BLOCK)), F.concat(F.lit("<think>only "), plain)]
        out = F.when(F.length(user) % 8 == 7, plain)
        for k, kind in enumerate(kinds):
            out = out.when(F.length(user) % 8 == k, kind)
        return out

    return Scripted(answer)


def with_carriage_returns(files: DataFrame) -> DataFrame:
    """A third of the files with CR LF line ends, a third with CR alone."""
    c = F.col("content")
    return files.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.replace(c, F.lit("\n"), F.lit("\r\n")))
                            .when(F.col("doc_id") % 3 == 1, F.replace(c, F.lit("\n"), F.lit("\r"))).otherwise(c))


def with_blanks(docs: DataFrame) -> DataFrame:
    """Every seventh text is white space, every eleventh empty."""
    return docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" \t\n ")).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")))


def with_markers(docs: DataFrame) -> DataFrame:
    """Texts that end in a line with a suppression comment, or nearly one."""
    ends = ["x = 1  # tool-ignore-sec", "y(); // ignore-sec ", "// ignore-sec here", "z  #ignore-secs", "//my.tool-ignore-sec"]
    pick = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.withColumn("text", F.concat("text", F.lit("\n"), pick))


def wants_fix() -> Column:
    """Roots with names of even length ask for edit blocks."""
    return F.length("source") % 2 == 0


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as a token stream ``(response_id, seq, chunk)``."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    n = F.length("text")
    pieces = c.select(
        (c.conv_id * 1000 + c.turn).alias("response_id"),
        (c.conv_id % 5).alias("mode"),
        "text",
        F.explode(
            F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / TOKEN_PIECE).cast("int") - 1))
            .otherwise(F.array().cast("array<int>"))
        ).alias("seq"),
    )
    raw = F.expr(_raw_sql())
    mode, seq = F.col("mode"), F.col("seq")
    chunk = (
        F.when((mode == 1) & (seq == 0), F.concat(F.lit("a</think>b</think>"), raw))
        .when((mode == 2) & (seq == 0), F.concat(raw, F.lit("<thi")))
        .when((mode == 2) & (seq == 1), F.concat(F.lit("nk>"), raw))
        .when(mode.isin(3, 4) & (seq == 0), F.concat(F.lit("lead <think>"), raw))
        .when(mode.isin(3, 4) & (seq == 2),
              F.concat(F.substring(raw, 1, 10), F.lit("</think>"),
                       F.expr(f"substring({_raw_sql()}, 11)")))
        .otherwise(raw)
    )
    return pieces.select("response_id", seq.cast("bigint").alias("seq"), chunk.alias("chunk"))


def _raw_sql() -> str:
    return f"substring(text, seq * {TOKEN_PIECE} + 1, {TOKEN_PIECE})"


def patch_search(doc_id: Column, text: Column) -> Column:
    first40 = F.substring(text, 1, 40)
    m = doc_id % 4
    return (
        F.when(m == 1, F.concat(F.lit("absent text "), doc_id.cast("string")))
        .when(m == 3, F.concat(first40, F.lit("  ")))
        .otherwise(first40)
    )


def patch_target(doc_id: Column) -> Column:
    return F.when(doc_id % 4 == 2, F.concat(F.lit("missing/"), doc_id.cast("string"))) \
        .otherwise(F.concat(F.lit("src/f"), doc_id.cast("string"), F.lit(".py")))


def patch_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per document holding two SEARCH/REPLACE blocks.

    Block 2 edits the same file and searches the text block 1 wrote, so the
    apply step has to see patches in order.
    """
    d = table(spark, sf_dir, "documents")
    target = patch_target(d.doc_id)
    text = F.concat(
        F.lit("Suggested fixes for document "), d.doc_id.cast("string"), F.lit(".\n"),
        F.lit("<<<< SEARCH file:"), target, F.lit("\n"),
        patch_search(d.doc_id, d.text), F.lit("\n==== REPLACE\n"),
        F.lit(FIRST_REPLACEMENT), F.lit("\n>>>>\n"),
        F.lit("Then:\n<<<< SEARCH file: "), target, F.lit(" \n"),
        F.lit(FIRST_REPLACEMENT), F.lit("\n==== REPLACE\n"),
        F.lit(SECOND_REPLACEMENT), F.lit("\n>>>>\n"),
    )
    return d.select(d.doc_id.alias("response_id"), text.alias("text"))


def second_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later answer to each document's file: its first block searches what
    the first answer wrote, its second the text that the first answer found."""
    d = table(spark, sf_dir, "documents")
    target = patch_target(d.doc_id)
    block = lambda search, new: [F.lit("<<<< SEARCH file:"), target, F.lit("\n"), search, F.lit("\n==== REPLACE\n"), F.lit(new), F.lit("\n>>>>\n")]
    text = F.concat(*block(F.lit(SECOND_REPLACEMENT.split("\n")[0]), THIRD_REPLACEMENT), *block(F.substring(d.text, 1, 40), FIRST_REPLACEMENT))
    return d.select((d.doc_id + SECOND_ANSWERS_FROM).alias("response_id"), text.alias("text"))


def patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files the patch answers target: ``src/f{doc_id}.py`` holding the document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("src/f"), d.doc_id.cast("string"), F.lit(".py")).alias("path"),
        d.text.alias("content"),
    )


MALFORMED_LINE = '{"response": "unterminated'
DONE_LINE = '{"done": true}'
DONE_LINE_NO = 1_000_000


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token stream as raw JSON lines, with blank, malformed and
    non-token lines mixed in: ``(response_id, line_no, line)``."""
    t = tokens(spark, sf_dir)
    good = t.select("response_id", (F.col("seq") * 2).alias("line_no"),
                    F.to_json(F.struct(F.col("chunk").alias("response"))).alias("line"))
    bad = t.where(F.col("seq") % 7 == 3).select(
        "response_id", (F.col("seq") * 2 + 1).alias("line_no"), F.lit(MALFORMED_LINE).alias("line"))
    blank = t.where(F.col("seq") % 11 == 5).select(
        "response_id", (F.col("seq") * 2 + 1).alias("line_no"), F.lit("").alias("line"))
    done = t.select("response_id").distinct().select(
        "response_id", F.lit(DONE_LINE_NO).cast("bigint").alias("line_no"), F.lit(DONE_LINE).alias("line"))
    return good.unionByName(bad).unionByName(blank).unionByName(done)


FINDING_PREFIX = "HIGH | app.py | "
FINDING_SUFFIX = " | sanitize input"


def audit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit answers ``(response_id, final, thinking)`` from assistant turns:
    all-clear, thinking only, one finding per line, or free text."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    m = c.conv_id % 4
    lines = F.split(c.text, "\n", -1)
    as_findings = F.array_join(
        F.transform(lines, lambda l: F.concat(F.lit(FINDING_PREFIX), l, F.lit(FINDING_SUFFIX))), "\n")
    return c.select(
        (c.conv_id * 1000 + c.turn).alias("response_id"),
        F.when(m == 0, F.concat(c.text, F.lit("\nNO_VULNERABILITIES_FOUND")))
        .when(m == 1, F.lit("")).when(m == 2, as_findings).otherwise(c.text).alias("final"),
        F.when(m == 1, c.text).otherwise(F.lit("")).alias("thinking"),
    )


def fenced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated test files, some wrapped in a code fence: ``(response_id, final)``."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    m = c.conv_id % 3
    return c.select(
        (c.conv_id * 1000 + c.turn).alias("response_id"),
        F.when(m == 0, F.concat(F.lit("```python\n"), c.text, F.lit("\n```")))
        .when(m == 1, F.concat(F.lit("  ```\n"), c.text)).otherwise(c.text).alias("final"),
    )


def existing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents generated earlier: a tutorial for roots whose number is below 5."""
    roots = files_base(spark, sf_dir).select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)$", 1)
    return roots.where((F.length(n) > 0) & (n.cast("int") < 5)).select(
        F.concat(F.lit("docs/tutorial/"), F.col("source"), F.lit(".md")).alias("path"),
        F.concat(F.lit("Earlier tutorial for "), F.col("source")).alias("content"))


def scripted_model():
    """The answers of ``scripted`` from a generator."""
    def call(user, system, purpose, route):
        text, kind = "\n".join([x for x in user.splitlines() if x.strip()][:3]).strip(), len(user) % 8
        return {0: "", 1: None, 2: f"{text}\n{K.ALL_CLEAR_SENTINEL}", 3: SCRIPT_FINDINGS + text, 4: f"<think>first\n{text[:20]}</think>{text}",
                5: text + SCRIPT_BLOCK, 6: f"<think>only {text}", 7: text}[kind]

    return call
