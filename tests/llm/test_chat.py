"""Chat formatting: round trip, loss mask, turn order."""

from quarry.llm import chat


def run(spark, rows):
    df = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string"))
    df = df.withColumn("formatted", chat.formatted_text(df.segments))
    df = df.withColumn("back", chat.read_back(df.formatted)).withColumn("trained", chat.trained_text(df.segments))
    return {r.conv_id: r for r in df.collect()}


def test_round_trip_and_order(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", hard, ""), (1, 0, "user", hard, ""), (2, 0, "user", None, ""), (2, 1, "assistant", "", ""),
            (3, 0, "assistant", "first", ""), (4, 0, "user", "a", ""), (4, 0, "user", "a", ""), (4, 1, None, "\\e|\\l", ""),
            (5, 0, "tool<|>", "x\\", ""), (5, 1, "assistant", "</turn>\n" * 3, ""), (None, None, "user", "long " * 50_000, "")]
    got = run(spark, rows)
    text = {c: [(x.role, x.text) for x in r.back] for c, r in got.items()}
    assert text[1] == [("user", hard), ("assistant", hard)] and got[1].valid and got[1].trained == hard
    assert text[2] == [("user", ""), ("assistant", "")] and got[2].valid and got[2].trained == ""
    assert text[3] == [("assistant", "first")] and not got[3].valid and got[3].n_bad_turns == 1
    assert text[4] == [("user", "a"), ("user", "a"), ("", "\\e|\\l")] and not got[4].valid
    assert text[5] == [("tool<|>", "x\\"), ("assistant", "</turn>\n" * 3)] and got[5].trained == "</turn>\n" * 3
    assert text[None] == [("user", "long " * 50_000)] and not got[None].valid
    assert [s.loss for s in got[1].segments] == [False] * 4 + [True, False]
    assert run(spark, rows[:0]) == {}


def test_no_python_in_plan(spark):
    df = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert "Python" not in df._jdf.queryExecution().toString()
