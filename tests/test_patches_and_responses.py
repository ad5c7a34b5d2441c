"""Edit blocks, reasoning split, JSON lines, verdicts (cases modelled on the
reference's unit tests, re-expressed as table rows)."""

import json

from pyspark.sql import functions as F

from quarry.operators import patches as PT
from quarry.operators import responses as RS

BLOCK = "<<<< SEARCH file:{f}\n{s}\n==== REPLACE\n{r}\n>>>>"


def _parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "response_id long, text string")
    return PT.parse_patches(df).orderBy("response_id", "patch_no").collect()


def test_parse_zero_one_two_multiline(spark):
    texts = ["no blocks here",
             "intro\n" + BLOCK.format(f=" a.py ", s="x = 1", r="x = 2"),
             BLOCK.format(f="a.py", s="a", r="b") + "\ntext\n" + BLOCK.format(f="b.py", s="c", r="d"),
             BLOCK.format(f="m.py", s="def f():\n    return 1", r="def f():\n    return 2\n")]
    rows = _parse(spark, texts)
    by = {}
    for r in rows:
        by.setdefault(r.response_id, []).append((r.file, r.search, r.replace))
    assert 0 not in by
    assert by[1] == [("a.py", "x = 1", "x = 2")]
    assert by[2] == [("a.py", "a", "b"), ("b.py", "c", "d")]
    assert by[3] == [("m.py", "def f():\n    return 1", "def f():\n    return 2\n")]


def _apply(spark, patches, files):
    p = spark.createDataFrame(patches, "response_id long, patch_no int, file string, search string, replace string")
    f = spark.createDataFrame(files, "path string, content string")
    t = PT.patch_targets(p, f)
    a = PT.apply_patches(p, f)
    res = {(r.response_id, r.patch_no): (r.applied, r.error) for r in PT.patch_results(a).collect()}
    content = {(r.response_id, r.file): r.content for r in a.collect() if r.content is not None}
    return res, content


def test_apply_cases(spark):
    files = [("f.py", "a = 1\nb = 2\na = 1\n"), ("ws.py", "x = 1   \ny = 2\n")]
    patches = [
        (1, 0, "f.py", "a = 1", "a = 9"),            # applied, first occurrence only
        (2, 0, "nope.py", "a", "b"),                   # file missing
        (3, 0, "f.py", "zzz", "q"),                    # text missing
        (4, 0, "ws.py", "x = 1\ny = 2", "x = 3"),     # trailing blanks -> normalised
        (5, 0, "f.py", "a = 1", "c = 3"),              # ordered: second sees the first
        (5, 1, "f.py", "c = 3", "d = 4"),
    ]
    res, content = _apply(spark, patches, files)
    assert res[(1, 0)] == (True, None)
    assert content[(1, "f.py")] == "a = 9\nb = 2\na = 1\n"
    assert res[(2, 0)][0] is False and "nope.py" in res[(2, 0)][1]
    assert res[(3, 0)][0] is False
    assert content[(3, "f.py")] == "a = 1\nb = 2\na = 1\n"
    assert res[(4, 0)] == (True, None)
    assert content[(4, "ws.py")] == "x = 3"
    assert content[(5, "f.py")] == "d = 4\nb = 2\na = 1\n"


def test_zero_patches_change_nothing(spark):
    p = spark.createDataFrame([], "response_id long, patch_no int, file string, search string, replace string")
    f = spark.createDataFrame([("f.py", "x")], "path string, content string")
    assert PT.apply_patches(p, f).count() == 0


def test_one_match_and_one_fold(spark):
    from quarry.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    parsed = plan(C.parsed_patches(spark, sf))
    assert parsed.count("regexp_extract_all(") == 1
    applied = plan(C.q_apply_patches(spark, sf))
    assert applied.count("aggregate(") == 1 and applied.count("regexp_extract_all(") == 1


def snapshot(spark, patches, files, **kw):
    p = spark.createDataFrame(patches, "response_id long, patch_no int, file string, search string, replace string")
    f = spark.createDataFrame(files, "path string, content string")
    whole, results = PT.patch_snapshot(p, f, **kw)
    return {r.path: (r.content, r.n_applied, r.n_failed) for r in whole.collect()}, \
        {(r.response_id, r.patch_no): (r.file, r.applied, r.error is None, r.conflict) for r in results.collect()}


def test_answers_to_one_file_meet_in_one_snapshot(spark):
    """Answer 2 searches what answer 1 wrote; answer 3 what answer 1 removed."""
    patches = [(2, 0, "a.py", "one!", "two"), (1, 0, "a.py", "zero", "one!"), (3, 0, "a.py", "zero", "never"), (3, 1, "b.py", "x  ", "y"),
               (3, 2, "gone.py", "x", "y"), (4, 0, "a.py", "nowhere", "y")]
    files = [("a.py", "zero\nend"), ("b.py", "x\nq"), ("untouched.py", "same"), ("empty.py", "")]
    for per_round in (1000, 1, 2):
        whole, results = snapshot(spark, patches, files, per_round=per_round)
        assert whole == {"a.py": ("two\nend", 2, 2), "b.py": ("y\nq", 1, 0), "untouched.py": ("same", 0, 0), "empty.py": ("", 0, 0)}
        assert results == {(1, 0): ("a.py", True, True, False), (2, 0): ("a.py", True, True, False), (3, 0): ("a.py", False, False, True),
                           (3, 1): ("b.py", True, True, False), (3, 2): ("gone.py", False, False, False), (4, 0): ("a.py", False, False, False)}
    assert snapshot(spark, [], files) == ({p: (c, 0, 0) for p, c in files}, {})


def test_many_answers_to_one_hot_file(spark):
    """Each answer counts one up; more of them than a round holds."""
    patches = [(i, 0, "hot.py", f"n = {i}\n", f"n = {i + 1}\n") for i in range(60)] + [(100 + i, 0, f"f{i}.py", "a", "b") for i in range(20)]
    files = [("hot.py", "n = 0\n")] + [(f"f{i}.py", "a a") for i in range(25)]
    whole, results = snapshot(spark, patches, files, per_round=7)
    assert whole["hot.py"] == ("n = 60\n", 60, 0) and len(results) == 80
    assert {p: c[0] for p, c in whole.items() if p != "hot.py"} == {f"f{i}.py": "b a" if i < 20 else "a a" for i in range(25)}


def test_normalised_text_is_that_of_split_lines(spark):
    texts = ["", "a", "a \n b\t", "a\n\n", "\n", " \n ", "x  \r\ny\x0b z \x1c", "a\u00a0\u2028b \u3000", "\r\r\n\n", "q\x1f\x85", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", PT._normalized(F.col("t")).alias("n")).collect()}
    assert got == {i: "\n".join(x.rstrip() for x in t.splitlines()) for i, t in enumerate(texts)}


def by_tag_positions(chunks):
    """W3 from its rules alone: where the tags stand decides for every token
    whether it closes, thinks or speaks. Returns both texts and the last flag."""
    bare = [c.replace("<think>", "") for c in chunks]
    closing = {i for i, c in enumerate(bare) if "</think>" in c}
    opening = {i for i, c in enumerate(chunks) if "<think>" in c} - closing
    latest = [max((k for k in opening | closing if k <= i), default=None) for i in range(len(chunks))]
    thinks = [i for i, k in enumerate(latest) if k in opening]
    sides = {i: (bare[i].split("</think>") + [""])[:2] for i in closing}
    sides |= {i: (bare[i], "") if i in thinks else ("", bare[i]) for i in range(len(chunks)) if i not in closing}
    thinking, final = ("".join(sides[i][k] for i in range(len(chunks))) for k in (0, 1))
    return thinking, final, bool(chunks) and latest[-1] in opening


STREAMS = {
    1: ["Hello ", "world"],
    2: ["<think>", "step one ", "step two", "</think>", "Answer"],
    3: ["pre <think>inline</think> post"],
    4: ["<think>a</think>b", "<think>c</think>d"],
    5: ["x</think>y</think>z", "tail"],
    6: ["<thi", "nk>not a tag"],
}


def _tokens(spark):
    rows = [(k, i, c) for k, cs in STREAMS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "response_id long, seq long, chunk string")


def test_split_reasoning_matches_state_machine(spark):
    got = {r.response_id: (r.thinking, r.final, r.is_thinking)
           for r in RS.split_reasoning(_tokens(spark)).collect()}
    assert got == {k: by_tag_positions(v) for k, v in STREAMS.items()}


def test_empty_stream_emits_nothing(spark):
    empty = spark.createDataFrame([], "response_id long, seq long, chunk string")
    assert RS.split_reasoning(empty).count() == 0


def test_stream_final_state_equals_batch(spark, tmpdir_fresh):
    from quarry.streaming import reasoning as XR
    inp, out, ck = (f"{tmpdir_fresh}/{n}" for n in ("in", "out", "ck"))
    # each arrival keyed by response, as a partitioned log would deliver it
    _tokens(spark).where("seq < 2").repartition(2, "response_id").write.parquet(inp)
    _tokens(spark).where("seq >= 2").repartition(2, "response_id").write.mode("append").parquet(inp)
    stream = spark.readStream.schema(XR.TOKEN_SCHEMA).option("maxFilesPerTrigger", 2).parquet(inp)
    XR.run_available(XR.split_reasoning_stream(stream, idle_ms=None), out, ck)
    states = spark.read.parquet(out)
    last = {r.response_id: (r.thinking_len, r.final_len, r.is_thinking) for r in
            states.groupBy("response_id").agg(F.max_by(F.struct("thinking_len", "final_len", "is_thinking"), "seq")
                                              .alias("s")).select("response_id", "s.*").collect()}
    assert states.count() == sum(len(v) for v in STREAMS.values())
    rebuilt = {}
    for r in sorted(states.collect(), key=lambda r: (r.response_id, r.seq)):
        t, f = rebuilt.get(r.response_id, ("", ""))
        rebuilt[r.response_id] = (t + r.thinking_delta, f + r.final_delta)
    for k, v in STREAMS.items():
        t, f, flag = by_tag_positions(v)
        assert last[k] == (len(t), len(f), flag)
        assert rebuilt[k] == (t, f)


def _run_stream(spark, folder, arrivals, make=None):
    """Each arrival is one micro-batch; returns the rows by (response, seq)."""
    import time

    from quarry.streaming import reasoning as XR
    inp, out, ck = (f"{folder}/{n}" for n in ("in", "out", "ck"))
    for part in arrivals:
        spark.createDataFrame(part, XR.TOKEN_SCHEMA).coalesce(1).write.mode("append").parquet(inp)
        time.sleep(0.05)
    stream = spark.readStream.schema(XR.TOKEN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(inp)
    XR.run_available(XR.split_reasoning_stream(stream, idle_ms=None), out, ck)
    return sorted(spark.read.parquet(out).collect(), key=lambda r: (r.response_id, r.seq))


def test_late_and_replayed_tokens(spark, tmpdir_fresh):
    tokens = [(1, i, c) for i, c in enumerate(["a<think>", "b", "c</think>d", None, "e"])]
    rows = _run_stream(spark, tmpdir_fresh, [[tokens[0], tokens[2]], [tokens[4], tokens[0]], [tokens[1], tokens[2]], [tokens[3]]])
    assert [(r.seq, r.thinking_delta, r.final_delta, r.is_thinking) for r in rows] == [
        (0, "a", "", True), (1, "b", "", True), (2, "c", "d", False), (3, "", "", False), (4, "", "e", False)]
    assert (rows[-1].thinking_len, rows[-1].final_len) == (3, 2)


def test_available_run_with_a_hole_equals_batch(spark, monkeypatch, tmpdir_fresh):
    from quarry.plans import catalog
    from quarry.streaming import reasoning as XR
    rows = [(1, 0, "a<think>"), (1, 1, "b"), (1, 3, "c</think>d"), (1, 4, None), (1, 6, "e"), (2, 1, "<think>x"), (2, 2, "y"), (3, 0, "z")]
    tokens = spark.createDataFrame(rows, XR.TOKEN_SCHEMA)
    monkeypatch.setattr(catalog.V, "tokens", lambda spark, sf_dir: tokens)
    got = sorted(catalog.q_split_reasoning_stream(spark, "").collect(), key=lambda r: (r.response_id, r.seq))
    assert [(r.response_id, r.seq) for r in got] == [r[:2] for r in rows]
    for b in RS.split_reasoning(tokens).collect():
        mine = [r for r in got if r.response_id == b.response_id]
        assert ("".join(r.thinking_delta for r in mine), "".join(r.final_delta for r in mine), mine[-1].is_thinking) == (b.thinking, b.final, b.is_thinking)
        assert (mine[-1].thinking_len, mine[-1].final_len) == (len(b.thinking), len(b.final))
    # no run yet: nothing waits
    assert XR.waiting_tokens(spark, f"{tmpdir_fresh}/none").count() == 0


class Handle:
    """State variables and timers of one key, kept in memory."""

    class Value:
        now = None

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

    class Map(dict):
        def containsKey(self, key):
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

        def iterator(self):
            return iter(list(self.items()))

    def __init__(self):
        self.timers, self.kept = [], {}

    def getValueState(self, name, schema, ttl):
        return self.kept.setdefault(name, (self.Value(), ttl))[0]

    def getMapState(self, name, key, value, ttl):
        return self.kept.setdefault(name, (self.Map(), ttl))[0]

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_idle_response_gives_up_its_gap_and_goes_on():
    """After the idle time the early tokens are applied without the missing
    one; tokens that come later continue there."""
    import pandas as pd

    from quarry.streaming import reasoning as XR
    from quarry.streaming.reasoning_state import KEEP_MS
    handle, step = Handle(), XR.processor(XR.IDLE_MS)
    step.init(handle)

    def send(ms, *tokens):
        rows = pd.DataFrame(tokens, columns=["seq", "chunk"])
        return [r for out in step.handleInputRows((7,), iter([rows]), Clock(ms)) for r in out.itertuples()]

    assert send(5, (1, "x<think>"), (3, "y</think>z")) == [] and send(6, (5, "v")) == []
    assert handle.timers == [6 + XR.IDLE_MS] and set(handle.kept["early"][0]) == {(1,), (3,), (5,)}
    (out,) = step.handleExpiredTimer((7,), Clock(0), None)
    assert out.seq.tolist() == [1, 3, 5] and out.final_delta.tolist() == ["", "z", "v"] and out.thinking_delta.tolist() == ["x", "y", ""]
    assert not handle.kept["early"][0] and handle.kept["head"][1] == KEEP_MS
    later = send(9, (3, "replay"), (7, "late"), (6, "w"))
    assert [(r.seq, r.final_delta, r.thinking_len, r.final_len, r.is_thinking) for r in later] == [(6, "w", 2, 3, False), (7, "late", 2, 7, False)]
    assert list(step.handleExpiredTimer((7,), Clock(0), None)) == []


def test_a_batch_touches_only_its_own_tokens():
    """The cost of a batch follows its tokens, however many others wait."""
    import pandas as pd

    from quarry.streaming import reasoning as XR
    handle, step = Handle(), XR.processor(None)
    step.init(handle)
    touched = []
    for name in ("containsKey", "getValue", "updateValue", "removeKey", "iterator"):
        plain = getattr(Handle.Map, name)
        setattr(step.early, name, lambda *a, plain=plain: (touched.append(a), plain(step.early, *a))[1])
    waiting = pd.DataFrame({"seq": range(100, 1100), "chunk": "x"})
    assert list(step.handleInputRows((1,), iter([waiting]), Clock(0))) == [] and len(step.early) == 1000
    touched.clear()
    (out,) = step.handleInputRows((1,), iter([pd.DataFrame({"seq": [0, 1], "chunk": ["a", "b"]})]), Clock(0))
    assert out.seq.tolist() == [0, 1] and len(touched) <= 6 and len(step.early) == 1000
    (out,) = step.handleInputRows((1,), iter([pd.DataFrame({"seq": list(range(2, 100)), "chunk": "y"})]), Clock(0))
    assert out.seq.tolist() == list(range(2, 1100)) and not step.early and step.head.get()[0] == 1100


def test_few_early_tokens_are_read_in_one_call():
    """A gap that closes costs no call for each token that waited."""
    import pandas as pd

    from quarry.streaming import reasoning as XR
    handle, step = Handle(), XR.processor(None)
    step.init(handle)
    touched = []
    for name in ("containsKey", "getValue", "updateValue", "removeKey", "iterator", "clear"):
        plain = getattr(Handle.Map, name)
        setattr(step.early, name, lambda *a, plain=plain: (touched.append(a), plain(step.early, *a))[1])
    send = lambda seqs: list(step.handleInputRows((1,), iter([pd.DataFrame({"seq": list(seqs), "chunk": [f"<{s}>" for s in seqs]})]), Clock(0)))
    assert send([*range(10, 30), 40]) == []
    touched.clear()
    (out,) = send([0, 12, *range(1, 10)])  # 40 goes on waiting
    assert out.seq.tolist() == list(range(30)) and set(step.early) == {(40,)} and len(touched) <= 1 + 20
    touched.clear()
    (out,) = send(range(30, 40))
    assert out.seq.tolist() == list(range(30, 41)) and out.final_delta.tolist() == [f"<{s}>" for s in range(30, 41)]
    assert not step.early and len(touched) == 2


def test_lines_into_reasoning(spark, tmpdir_fresh):
    """X2 feeds X1: lines without a token close their gap and add nothing."""
    from quarry.streaming import reasoning as XR
    lines = [json.dumps({"response": "<think>a"}), "", "{bad", json.dumps({"response": "b</think>c"}), json.dumps({"done": True}), json.dumps({"response": "d"})]
    inp, out, ck = (f"{tmpdir_fresh}/{n}" for n in ("in", "out", "ck"))
    for part in ((3, 4, 5), (0, 1, 2)):
        spark.createDataFrame([(f"9\t{i}\t{lines[i]}",) for i in part], "value string").coalesce(1).write.mode("append").text(inp)
    XR.run_available(XR.response_reasoning_stream(spark, inp, idle_ms=None), out, ck)
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r.seq)
    assert "".join(r.thinking_delta for r in rows) == "ab" and "".join(r.final_delta for r in rows) == "cd"
    assert [r.seq for r in rows] == list(range(6))


def test_finding_formats(spark):
    text = "[High] - [a.py:3] - [sql injection] - [bind]\nlow | b | c | d\nMedium - x - y - z\nHighly - a - b - c"
    rows = RS.findings(spark.createDataFrame([(1, text)], "response_id long, final string")).orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in rows] == [("HIGH", "a.py:3", "sql injection", "bind"), ("LOW", "b", "c", "d"), ("MEDIUM", "x", "y", "z")]


def test_json_lines(spark):
    lines = [json.dumps({"response": "Hel"}), json.dumps({"response": "lo"}), "",
             json.dumps({"done": True}), "{not json", json.dumps({"response": "!"})]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    toks = [r.token for r in RS.parse_response_lines(df).orderBy("line_no").collect()]
    assert toks == ["Hel", "lo", "!"]


def test_verdict_and_fence(spark):
    df = spark.createDataFrame([(1, "All good. NO_VULNERABILITIES_FOUND", ""), (2, "HIGH | a.py:3 | sqli | bind", ""),
                                (3, "   ", "")], "response_id long, final string, thinking string")
    got = {r.response_id: (r.status, r.exit_code) for r in RS.verdict(df).collect()}
    assert got == {1: ("clear", 0), 2: ("findings", 1), 3: ("error", 1)}
    f = RS.findings(df).first()
    assert (f.severity, f.location, f.description, f.remediation) == ("HIGH", "a.py:3", "sqli", "bind")
    fences = spark.createDataFrame([("```py\ncode\n```",), ("```\nonly",), ("plain",)], "t string")
    out = [r.c for r in fences.select(RS.strip_fence(F.col("t")).alias("c")).collect()]
    assert out == ["code", "```\nonly", "plain"]


def test_generator_called_once_per_prompt(spark, tmpdir_fresh):
    """A plugged-in model is called once per prompt even when answers fan out."""
    import os
    from quarry.operators.generate import generate_batch
    log = os.path.join(tmpdir_fresh, "calls")
    os.makedirs(log)

    def factory():
        def call(user, system, purpose, route):
            assert route == {"model": "gemma4", "num_ctx": 4096, "num_predict": 512}
            open(os.path.join(log, user), "w").close()
            if user == "boom":
                raise RuntimeError("model down")
            return f"  answer to {user}  "
        return call

    prompts = spark.createDataFrame([(i, "fast", "sys", u) for i, u in enumerate(["a", "b", "boom"])],
                                    "request_id int, purpose string, system string, user string")
    ans = generate_batch(prompts, factory)
    got = {r.user: r.response for r in ans.collect()}
    assert got == {"a": "answer to a", "b": "answer to b", "boom": None}
    assert {r.user: r.error for r in ans.collect()} == {"a": None, "b": None, "boom": "RuntimeError: model down"}
    ans.groupBy("purpose").count().collect()
    assert sorted(os.listdir(log)) == ["a", "b", "boom"]
