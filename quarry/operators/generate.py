"""Model map step (M1) and prompt tables.

``generate_batch`` adds ``response`` and ``error`` to a prompt table
``(purpose, system, user, ...)``; ``merge_answers`` reduces the answers to the
windows of one input to one answer.

* With no generator, the offline default answers deterministically with the
  first three non-blank lines of the user text, stripped - a pure column
  expression, so the whole model pipeline runs (and is checked) without a
  model.
* With a generator, it is called once per distinct prompt and route. The factory
  runs once per task (model load); rows are sorted by model inside each
  partition, so a task switches models at most once per model. A failing call
  yields NULL and its error. Answers are logged as they come (``AnswerLog``), so
  downstream fan-out, a lost task or a later run with the same log never
  repeats a call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import constants as K
from quarry.functions import prompts as PR
from quarry.functions import text as TX
from quarry.operators.ordering import ordered_windows
from quarry.operators.responses import whole_answer
from quarry.operators.routing import route_model, routes
from quarry.session import scratch_path
from quarry.sinks.answer_log import AnswerLog
from quarry.sinks.tables import write_snapshot


def default_answer(user: Column) -> Column:
    lines = F.split(user, TX.LINE_BREAK, -1)
    kept = F.filter(lines, lambda l: l.rlike(TX.NON_BLANK_RE))
    return TX.py_strip(F.array_join(F.slice(kept, 1, 3), "\n"))


@dataclass(frozen=True)
class Scripted:
    """A stand-in for a model: the answer as a column of the user text."""

    answer: Callable[[Column], Column]


#: A factory, called once per task, of a function (user, system, purpose,
#: route) -> answer; ``route`` has ``model``, ``num_ctx`` and ``num_predict``. The
#: function may have an attribute ``stream`` that yields the answer in pieces.
GeneratorFactory = Callable[[], Callable[[str, str, str, dict], "str | None"]]


def generate_batch(prompts: DataFrame, generator: GeneratorFactory | Scripted | None = None,
                   route_table: DataFrame | None = None, log: str | None = None) -> DataFrame:
    """M1: the prompts with ``response`` and ``error`` (NULL unless the call
    failed; then ``response`` is NULL). Each prompt is routed by its purpose
    (J10) and the route goes to the generator. ``log`` names the folder of an
    answer log that outlives the run (default: one of this call's own)."""
    generator = generator or Scripted(default_answer)
    if isinstance(generator, Scripted):
        return prompts.withColumn("response", generator.answer(F.col("user"))).withColumn("error", F.lit(None).cast("string"))
    spark = prompts.sparkSession
    routed = route_model(prompts, routes(spark) if route_table is None else route_table)
    fields = ["model", "num_ctx", "num_predict"]
    keyed = routed.withColumn("_key", F.sha2(F.to_json(F.struct("purpose", "system", "user", *fields)), 256))
    keyed = write_snapshot(keyed, "prompts")
    answers = AnswerLog(spark, log or scratch_path(spark, "answer-log"))
    answers.fill(keyed.withColumnRenamed("_key", "key"), generator, fields)
    said = answers.answers().withColumnRenamed("key", "_key")
    return keyed.join(said, "_key", "left").select(*prompts.columns, "response", "error")


def _pieces(text: Column) -> Column:
    n = F.ceil(F.length(text) / TOKEN_CHARS).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * TOKEN_CHARS + 1, F.lit(TOKEN_CHARS)))
    return F.when(n > 0, cut)


#: Characters of a piece where an answer is not streamed by its generator.
TOKEN_CHARS = 20


def token_pieces(call, user: str, system: str, purpose: str, route: dict) -> Iterator[str]:
    """The pieces of an answer as the generator gives them: from its ``stream``
    if it has one, else the whole answer in pieces of ``TOKEN_CHARS``."""
    if hasattr(call, "stream"):
        yield from call.stream(user, system, purpose, route)
    else:
        text = call(user, system, purpose, route) or ""
        yield from (text[i : i + TOKEN_CHARS] for i in range(0, len(text), TOKEN_CHARS))


def generate_tokens(prompts: DataFrame, key: str, generator: GeneratorFactory | Scripted | None = None,
                    route_table: DataFrame | None = None) -> DataFrame:
    """M1 as a token stream: ``response_id`` (``key``), ``seq`` from 0 and
    ``chunk``, for W3. An empty answer has no rows. A failing call gives what it
    had said, and ends there. The rows are written once."""
    generator = generator or Scripted(default_answer)
    if isinstance(generator, Scripted):
        said = prompts.select(F.col(key).alias("response_id"), generator.answer(F.col("user")).alias("text"))
        return said.select("response_id", F.posexplode(_pieces(F.col("text"))).alias("seq", "chunk")) \
            .select("response_id", F.col("seq").cast("long").alias("seq"), "chunk")
    spark = prompts.sparkSession
    routed = route_model(prompts, routes(spark) if route_table is None else route_table)
    fields = ["model", "num_ctx", "num_predict"]
    schema = T.StructType([T.StructField("response_id", prompts.schema[key].dataType)] + T.StructType.fromDDL("seq long, chunk string").fields)

    def run(batches):
        call = generator()
        for pdf in batches:
            for rid, user, system, purpose, *route in pdf[[key, "user", "system", "purpose", *fields]].itertuples(index=False):
                said = []
                try:
                    for piece in token_pieces(call, user, system, purpose, dict(zip(fields, route))):
                        said.append(piece)
                except Exception:
                    pass  # what was said stays
                if said:
                    yield pd.DataFrame({"response_id": rid, "seq": range(len(said)), "chunk": said})

    return write_snapshot(routed.sortWithinPartitions("model").mapInPandas(run, schema), "tokens")


NOT_SHORTER = "the answers do not get shorter by merging"


def final_answers(answers: DataFrame) -> DataFrame:
    """The answers without their reasoning."""
    return answers.withColumn("response", whole_answer(F.coalesce("response", F.lit("")))[1])


def merge_answers(answers: DataFrame, keys: list[str], kind: str, generator: GeneratorFactory | Scripted | None = None,
                  limit: int = K.MAX_PAYLOAD_CHARS) -> DataFrame:
    """One answer per key: ``keys, response, error``.

    ``answers`` has the answers to the windows of each key's input (``window``,
    ``n_windows``, ``response``, ``error``). Where there are several, they are
    joined in order and merged by further prompts of at most ``limit``
    characters, level by level, until one is left. A key fails (``error``) if
    any of its calls failed, or if merging does not give it fewer prompts than
    the level before had; the other keys go on.
    """
    level = write_snapshot(answers.select(*keys, "window", "n_windows", "response", "error"), "answers")
    done, depth = [], 0
    while True:
        done.append(level.where("n_windows <= 1").select(*keys, "response", "error"))
        many = level.where("n_windows > 1")
        if many.isEmpty():
            break
        had = many.groupBy(*keys).agg(F.min("error").alias("failed"), F.max("n_windows").alias("had"))
        parts = ordered_windows(many, keys, F.col("window"), F.coalesce("response", F.lit("")), "\n\n", limit)
        parts = write_snapshot(parts.select(*keys, "window", "n_windows", F.col("text").alias("parts")), "parts")
        # a key whose answers are all empty has no text to merge
        empty = had.join(parts.select(*keys).distinct(), keys, "left_anti")
        done.append(empty.select(*keys, F.lit("").alias("response"), F.col("failed").alias("error")))
        parts = parts.join(had, keys)
        if depth:
            stuck = parts.where("window = 0 AND n_windows >= had")
            done.append(stuck.select(*keys, F.lit(None).cast("string").alias("response"), F.coalesce("failed", F.lit(NOT_SHORTER)).alias("error")))
            parts = parts.where("n_windows < had")
        prompts = parts.select(
            *keys, "window", "n_windows", "failed", F.lit(PR.ROUTE[kind]).alias("purpose"), PR.system(kind, sections=False).alias("system"),
            PR.user("merge").alias("user"))
        merged = final_answers(generate_batch(prompts, generator)).withColumn("error", F.coalesce("error", "failed"))
        level = write_snapshot(merged.select(*keys, "window", "n_windows", "response", "error"), "answers")
        depth += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
