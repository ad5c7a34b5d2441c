"""Model output back into tables.

Per-response groups are bounded by the model's output cap, so windows and
ordered collects keyed by ``response_id`` never hold more than one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import text as TX


def _json_object(line: Column) -> Column:
    return F.from_json(line, "map<string,string>")


def parsed_line(line: Column) -> Column:
    """S6 for one line: its token, or NULL if the line holds none."""
    return F.try_element_at(_json_object(line), F.lit("response"))


def parse_response_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """JSON lines -> tokens. Blank lines, malformed JSON and objects
    without a ``response`` key are skipped. The one-element explode keeps the
    parse from being repeated in the filter and the projection."""
    return lines.withColumn("_m", F.explode(F.array(_json_object(F.col(line_col))))).where(
        F.map_contains_key(F.col("_m"), "response")
    ).withColumn("token", F.col("_m")["response"]).drop("_m")


def _ordered_join(piece: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))),
                                    lambda s: s[piece]), "")


def reasoning_pieces(tokens: DataFrame, key: str = "response_id", seq: str = "seq",
                     chunk: str = "chunk") -> DataFrame:
    """Per token: the text it adds to thinking and final, and the flag after it.

    An opening tag anywhere sets the flag and every opening tag is removed; a
    closing tag clears it: part 0 goes to thinking, part 1 to final, further
    parts are dropped; otherwise the chunk goes where the flag points.
    """
    c = F.replace(F.col(chunk), F.lit(K.THINK_OPEN), F.lit(""))
    opened = F.col(chunk).contains(K.THINK_OPEN)
    closed = c.contains(K.THINK_CLOSE)
    parts = F.split(c, K.THINK_CLOSE, -1)
    after = F.when(closed, F.lit(False)).when(opened, F.lit(True))
    w = Window.partitionBy(key).orderBy(seq)
    before = F.coalesce(F.last("_after", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(False))
    t = tokens.select(key, seq, c.alias("_c"), opened.alias("_open"), closed.alias("_close"),
                      parts.alias("_parts"), after.alias("_after"))
    t = t.withColumn("_flag", F.col("_open") | before)
    return t.select(
        key, seq,
        F.when(F.col("_close"), F.get(F.col("_parts"), 0))
        .when(F.col("_flag"), F.col("_c")).otherwise(F.lit("")).alias("think_piece"),
        F.when(F.col("_close"), F.coalesce(F.get(F.col("_parts"), 1), F.lit("")))
        .when(~F.col("_flag"), F.col("_c")).otherwise(F.lit("")).alias("final_piece"),
        F.coalesce(F.last("_after", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)).alias("is_thinking"),
    )


def split_reasoning(tokens: DataFrame, key: str = "response_id", seq: str = "seq",
                    chunk: str = "chunk") -> DataFrame:
    """``(response_id, thinking, final, is_thinking)`` per non-empty stream."""
    p = reasoning_pieces(tokens, key, seq, chunk)
    return p.groupBy(key).agg(
        _ordered_join("think_piece", seq).alias("thinking"),
        _ordered_join("final_piece", seq).alias("final"),
        F.max_by("is_thinking", seq).alias("is_thinking"),
    )


def whole_answer(c: Column) -> tuple[Column, Column]:
    """W3 for an answer that came in one piece: ``(thinking, final)``."""
    text = F.replace(c, F.lit(K.THINK_OPEN), F.lit(""))
    sides = F.split(text, K.THINK_CLOSE, -1)
    closed, opened = F.size(sides) > 1, c.contains(K.THINK_OPEN)
    return (F.when(closed, F.get(sides, 0)).when(opened, text).otherwise(F.lit("")),
            F.when(closed, F.get(sides, 1)).when(opened, F.lit("")).otherwise(text))


def strip_fence(c: Column) -> Column:
    """After strip, drop the first and last line when the text starts
    with a fence, has at least two lines and its last line starts with one."""
    s = TX.py_strip(c)
    lines = TX.splitlines(s)
    n = F.size(lines)
    fenced = s.startswith("```") & (n >= 2) & F.get(lines, n - 1).startswith("```")
    return F.when(fenced, F.array_join(F.slice(lines, 2, F.greatest(n - 2, F.lit(0))), "\n")).otherwise(s)


def verdict(df: DataFrame, final: str = "final", thinking: str = "thinking") -> DataFrame:
    """Exit code per answer: 1 when empty, 0 when the all-clear sentinel
    appears anywhere, else 1."""
    out = TX.py_strip(F.concat(F.coalesce(F.col(final), F.lit("")), F.coalesce(F.col(thinking), F.lit(""))))
    status = F.when(F.length(out) == 0, F.lit("error")) \
        .when(out.contains(K.ALL_CLEAR_SENTINEL), F.lit("clear")).otherwise(F.lit("findings"))
    return df.withColumn("status", status).withColumn(
        "exit_code", F.when(F.col("status") == "clear", F.lit(0)).otherwise(F.lit(1)))


# ``[Severity] - [File/Line] - [Description] - [Remediation]``: the severity in
# any case, brackets optional, parts joined by " - " or "|".
FINDING_RE = (r"^\s*\[?(?i:(critical|high|medium|low))\]?\s*(?:\||\s-\s)\s*\[?(.*?)\]?\s*(?:\||\s-\s)"
              r"\s*\[?(.*?)\]?\s*(?:\||\s-\s)\s*\[?(.*?)\]?\s*$")


def findings(df: DataFrame, key: str = "response_id", text_col: str = "final") -> DataFrame:
    """One row per finding line ``[Severity] - [File/Line] - [Description]
    - [Remediation]``; the severity comes out in upper case."""
    lines = df.select(key, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    hit = lines.where(F.col("line").rlike(FINDING_RE))
    return hit.select(
        key, F.col("line_no").cast("int").alias("line_no"),
        F.upper(F.regexp_extract("line", FINDING_RE, 1)).alias("severity"),
        *[F.regexp_extract("line", FINDING_RE, i).alias(n)
          for i, n in enumerate(["location", "description", "remediation"], 2)])


def final_text(df: DataFrame, final: str = "final", thinking: str = "thinking") -> DataFrame:
    """Usable answer = strip(final); failure when final and thinking are both empty."""
    empty = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0)) == 0
    return df.withColumn("answer", TX.py_strip(F.coalesce(F.col(final), F.lit("")))) \
        .withColumn("failed", empty(final) & empty(thinking))


WAITING = K.WAITING_TEXT


def visible_output(df: DataFrame, show_thinking: bool = True, final: str = "final",
                   thinking: str = "thinking") -> DataFrame:
    """What a viewer shows: thinking (when non-empty and shown), then the
    final text (when non-empty), else a waiting placeholder."""
    th = F.when(F.lit(show_thinking) & (F.length(thinking) > 0), F.col(thinking))
    fi = F.when(F.length(final) > 0, F.col(final))
    shown = F.concat_ws("\n\n", th, fi)
    return df.withColumn("shown", F.when(F.length(shown) > 0, shown).otherwise(F.lit(WAITING)))
