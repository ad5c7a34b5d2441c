"""Answer log, token pieces and the token source: which calls are made."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import responses as RS
from quarry.operators.generate import generate_batch, generate_tokens
from quarry.sinks.answer_log import AnswerLog
from quarry.sources import corpus_views as V
from quarry.streaming import reasoning as XR
from quarry.streaming.token_source import PromptQueue, token_stream

SCHEMA = "id long, purpose string, system string, user string"


def prompts(spark, n, text="ask {}"):
    return spark.createDataFrame([(i, ("fast", "coding", "review")[i % 3], "s", text.format(i)) for i in range(n)], SCHEMA)


def counting(folder, broken=None, say="said {}"):
    """A generator that leaves a file for every call; ``broken``: a file whose
    presence ends the worker's task at the twentieth call."""
    def factory():
        def call(user, system, purpose, route):
            with open(os.path.join(folder, f"{user}-{time.time_ns()}"), "w"):
                pass
            if broken and os.path.exists(broken) and len(os.listdir(folder)) >= 20:
                raise SystemExit("the model went away")
            if user.endswith("13"):
                raise ValueError("no answer")
            return say.format(user)
        return call
    return factory


def calls(folder):
    out = {}
    for name in os.listdir(folder):
        user = name.rsplit("-", 1)[0]
        out[user] = out.get(user, 0) + 1
    return out


def test_a_generator_that_fails_half_way_is_called_once_per_prompt(spark, tmpdir_fresh):
    seen, broken, log = (os.path.join(tmpdir_fresh, x) for x in ("seen", "broken", "log"))
    os.mkdir(seen)
    open(broken, "w").close()
    asked = prompts(spark, 60)
    with pytest.raises(Exception):
        generate_batch(asked, counting(seen, broken), log=log)
    os.remove(broken)
    first = calls(seen)
    assert 20 <= sum(first.values())
    known = {r.key for r in AnswerLog(spark, log).answers().where("error IS NULL").collect()}
    out = {r.user: (r.response, r.error) for r in generate_batch(asked, counting(seen), log=log).collect()}
    assert out == {f"ask {i}": (f"said ask {i}", None) if i != 13 else (None, "ValueError: no answer") for i in range(60)}
    after = calls(seen)
    assert len(known) >= 15 and sum(after[u] - first.get(u, 0) for u in after) <= 60 - len(known)
    # what had an answer is not asked again; only the calls that broke or failed are
    again = generate_batch(asked, counting(seen), log=log)
    assert again.count() == 60 and {u for u, n in calls(seen).items() if n > after[u]} == {"ask 13"}


def test_equal_prompts_are_asked_once_and_fan_out_repeats_no_call(spark, tmpdir_fresh):
    asked = prompts(spark, 6).union(prompts(spark, 6)).withColumn("system", F.lit("x"))
    out = generate_batch(asked, counting(tmpdir_fresh))
    assert out.count() == out.where("response IS NOT NULL").count() == 12
    assert set(calls(tmpdir_fresh).values()) == {1}
    assert generate_batch(asked.limit(0), counting(tmpdir_fresh)).count() == 0


def streaming():
    """A generator that streams its answer; the reasoning tags are pieces of their own."""
    def pieces():
        class Model:
            def stream(self, user, system, purpose, route):
                yield from ["<think>", f"about {user}", "</think>", "it is ", user]

            def __call__(self, *a):
                return "".join(self.stream(*a))

        return Model()

    return pieces


def test_token_pieces_in_one_batch(spark):
    asked = prompts(spark, 5).withColumnRenamed("id", "response_id")
    split = {r.response_id: (r.thinking, r.final) for r in RS.split_reasoning(generate_tokens(asked, "response_id", streaming())).collect()}
    assert split == {i: (f"about ask {i}", f"it is ask {i}") for i in range(5)}
    whole = generate_tokens(asked, "response_id", lambda: lambda *a: "x" * 45)
    assert {(r.seq, len(r.chunk)) for r in whole.collect()} == {(0, 20), (1, 20), (2, 5)}


def test_token_source_repeats_no_piece_after_a_restart(spark, tmpdir_fresh):
    q, out, ck = PromptQueue(spark, f"{tmpdir_fresh}/queue"), f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck"
    asked = prompts(spark, 40).withColumnRenamed("id", "response_id")
    q.add(asked.where("response_id < 25"))
    XR.run_available(token_stream(q, streaming()), out, ck)
    assert spark.read.parquet(out).select("response_id").distinct().count() == 25
    q.add(asked.where("response_id >= 25"))
    XR.run_available(token_stream(q, streaming()), out, ck)
    XR.run_available(token_stream(q, streaming()), out, ck)
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("response_id", "seq").distinct().count() == 40 * 5
    split = {r.response_id: r.final for r in RS.split_reasoning(rows).collect()}
    assert split == {i: f"it is ask {i}" for i in range(40)}


def test_token_source_into_the_reasoning_stream(spark, tmpdir_fresh):
    q, out, ck = PromptQueue(spark, f"{tmpdir_fresh}/queue"), f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck"
    asked = prompts(spark, 16, "about {}\n  \nand more ").withColumnRenamed("id", "response_id")
    asked = asked.withColumn("user", F.concat("user", F.repeat(F.lit("y"), F.col("response_id").cast("int"))))
    q.add(asked)
    XR.run_available(XR.split_reasoning_stream(token_stream(q, V.scripted_model), idle_ms=None), out, ck)
    said = {}
    for r in spark.read.parquet(out).orderBy("response_id", "seq").collect():
        t, f = said.get(r.response_id, ("", ""))
        said[r.response_id] = (t + r.thinking_delta, f + r.final_delta)
    # the same from the stand-in as a column, in one batch
    want = RS.split_reasoning(generate_tokens(asked, "response_id", V.scripted()))
    assert said == {r.response_id: (r.thinking, r.final) for r in want.collect()} and len(said) > 10


def test_answers_are_written_while_a_task_goes_on(spark, tmpdir_fresh, monkeypatch):
    """By number and by time, not only at the end of the task."""
    from quarry.sinks import answer_log
    log, held = os.path.join(tmpdir_fresh, "log"), os.path.join(tmpdir_fresh, "held")
    monkeypatch.setattr(answer_log, "SECONDS_PER_FILE", 0.0)
    seconds = answer_log.SECONDS_PER_FILE

    def factory():
        def call(user, system, purpose, route):
            from quarry.sinks import answer_log as there
            there.SECONDS_PER_FILE = seconds  # in the worker
            files = [f for _, _, names in os.walk(log) for f in names if f.endswith(".parquet") and not f.startswith(".")]
            with open(held, "a") as f:
                f.write(f"{len(files)} ")
            return user
        return call

    monkeypatch.setattr(answer_log, "SLICES", 1)
    assert generate_batch(prompts(spark, 12), factory, log=log).where("response = user").count() == 12
    with open(held) as f:
        before = list(map(int, f.read().split()))
    assert len(before) == 12 and max(before) >= 5
