"""Budget cut (T4), probe de-duplication (W2), dominant language ties (A2),
context blocks (A4) — cases the original test suite did not cover."""

from quarry import constants as K
from quarry.operators import context as CX
from quarry.operators import corpus as CO


def test_budget_marks_every_cut_and_loses_nothing(spark):
    files = spark.createDataFrame([("r", p) for p in ("a.py", "b.py", "c.py")] + [("s", "x.y")], "source string, rel_path string")
    summ = spark.createDataFrame([("r", "a.py", "S" * 40), ("r", "b.py", None), ("s", "x.y", "ok")], "source string, rel_path string, summary string")
    rows = CX.budget_prompt(files, summ, num_ctx=10).collect()  # a budget of 30 characters
    whole = {"r": ("a.py\nb.py\nc.py", "### a.py\n" + "S" * 40 + "\n\n### b.py\n" + K.FAILED_SUMMARY), "s": ("x.y", "### x.y\nok")}
    for root, (tree, summaries) in whole.items():
        mine = sorted((r for r in rows if r.source == root), key=lambda r: r.window)
        assert [r.window for r in mine] == list(range(mine[0].n_windows))
        assert "".join(r.tree.replace(K.TRUNCATED_MARKER, "") for r in mine) == tree
        assert "".join(r.summaries.replace(K.TRUNCATED_MARKER, "") for r in mine) == summaries
    r = [x for x in rows if x.source == "r" and x.window == 0][0]
    # the tree gets min(14, 30 // 4) = 7, the summaries 30 - 7 = 23
    assert r.cut and r.tree == "a.py\nb." + K.TRUNCATED_MARKER and r.summaries == whole["r"][1][:23] + K.TRUNCATED_MARKER
    assert [(x.tree, x.summaries, x.cut, x.n_windows) for x in rows if x.source == "s"] == [(*whole["s"], False, 1)]


def test_large_budget_does_not_cut(spark):
    files = spark.createDataFrame([("r", f"d/{i:05d}.py") for i in range(9000)], "source string, rel_path string")
    summ = spark.createDataFrame([("r", "d/00000.py", "ok")], "source string, rel_path string, summary string")
    row = CX.budget_prompt(files, summ, num_ctx=131072).first()
    assert not row.cut and len(row.tree) == 9000 * 10 + 8999 and K.TRUNCATED_MARKER not in row.tree


def test_answers_are_merged_level_by_level(spark):
    from quarry.operators.generate import merge_answers

    def factory():
        return lambda user, system, purpose, route: "<think>hm</think>" + user[-60:]

    rows = [("a", i, 8, f"part {i} " + "x" * 60, None) for i in range(8)] + [("b", 0, 1, "alone", None),
            ("c", 0, 2, None, "Error: down"), ("c", 1, 2, "y", None), ("d", 0, 2, "", None), ("d", 1, 2, None, None)]
    ans = spark.createDataFrame(rows, "source string, window long, n_windows long, response string, error string")
    out = {r.source: r for r in merge_answers(ans, ["source"], "doc", factory, limit=150).collect()}
    assert set(out) == {"a", "b", "c", "d"} and out["b"].response == "alone" and out["b"].error is None
    assert len(out["a"].response) == 60 and out["a"].response.endswith("x") and out["c"].error == "Error: down"


def test_a_key_that_does_not_shrink_fails_alone(spark):
    from quarry.operators.generate import NOT_SHORTER, merge_answers

    def factory():
        return lambda user, system, purpose, route: "z" * 140 if "long" in user or "z" in user else user[-60:]

    rows = [("a", i, 4, f"part {i} " + "x" * 60, None) for i in range(4)] + [("b", i, 4, "long " + "y" * 100, None) for i in range(4)]
    ans = spark.createDataFrame(rows, "source string, window long, n_windows long, response string, error string")
    out = {r.source: r for r in merge_answers(ans, ["source"], "doc", factory, limit=150).collect()}
    assert set(out) == {"a", "b"} and out["a"].error is None and len(out["a"].response) == 60
    assert out["b"].error == NOT_SHORTER and out["b"].response is None


def test_no_text_in_a_window_over_a_root(spark):
    files = spark.createDataFrame([("r", "a.py")], "source string, rel_path string")
    summ = spark.createDataFrame([("r", "a.py", "S" * 40)], "source string, rel_path string, summary string")
    plan = CX.budget_prompt(files, summ)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window [" in line and ("tree" in line or "summaries" in line) for line in plan.split("\n"))


def test_dedup_hits_keeps_first_probe_then_rank(spark):
    hits = spark.createDataFrame([
        (0, 1, "a.py", "same text" + "x" * 200), (0, 2, "b.py", "other"),
        (1, 1, "c.py", "same text" + "x" * 150 + "different tail"), (1, 2, "d.py", "fresh")],
        "query_id int, rank int, file string, text string")
    kept = sorted((r.query_id, r.rank, r.file) for r in CX.dedup_hits(hits).collect())
    assert kept == [(0, 1, "a.py"), (0, 2, "b.py"), (1, 2, "d.py")]


def test_dominant_language_ties_and_generic(spark):
    files = spark.createDataFrame([("r1", "a.py"), ("r1", "b.ts"), ("r2", "x.md"), ("r3", "q.ts"), ("r3", "w.TS")],
                                  "source string, path string")
    got = {r.source: (r.language, r.n_files) for r in CO.dominant_language(files).collect()}
    assert got == {"r1": ("Python", 1), "r2": ("Generic", 0), "r3": ("TypeScript", 2)}


def test_context_block_formats(spark):
    hits = spark.createDataFrame([(7, 2, "b.py", "two", "0.5000"), (7, 1, "a.py", "one", "0.2500")],
                                 "query_id int, rank int, file string, text string, score string")
    r = CX.context_block(hits).first()
    assert r.context == "--- Chunk 1 (file: a.py) ---\none\n\n--- Chunk 2 (file: b.py) ---\ntwo"
    assert r.scored_context.startswith("--- Chunk 1 (file: a.py, score: 0.2500) ---\none")
