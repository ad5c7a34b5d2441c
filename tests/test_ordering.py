"""Ordered windows and ordered ranks against brute force, with a hot group."""

import random

from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import paths as P
from quarry.operators.corpus import concat_corpus
from quarry.operators.ordering import ordered_rank, ordered_windows


def _rows():
    rnd = random.Random(3)
    rows = [("hot", f"d{rnd.randint(0, 50)}/f{i}.py", "x" * rnd.randint(0, 3)) for i in range(20000)]
    rows += [("cold", f"a/f{i}.py", "y" * 40) for i in range(30)]
    rows += [("cold", "0big.py", "z" * 40000)]  # first in order and longer than the budget
    rows += [("tiny", "only.py", "")]
    return rows


def _joined(windows, group, col="text"):
    mine = sorted((r for r in windows if r.source == group), key=lambda r: r.window)
    assert [r.window for r in mine] == list(range(mine[0].n_windows))
    return mine, "".join(r[col] for r in mine)


def test_corpus_windows_are_the_whole_text(spark):
    rows = _rows()
    got = concat_corpus(spark.createDataFrame(rows, "source string, path string, content string").repartition(7)).collect()
    for src in {"hot", "cold", "tiny"}:
        full = "\n\n".join(f"### File: {p}\n{c}" for _, p, c in sorted((r for r in rows if r[0] == src), key=lambda r: r[1].split("/")))
        mine, text = _joined(got, src, "payload")
        assert text == full and all(r.total_chars == len(full) for r in mine)
        assert all(len(r.payload) == K.MAX_PAYLOAD_CHARS for r in mine[:-1]) and sum(len(r.payload) for r in mine) == len(full)


def test_windows_of_any_size(spark):
    """Windows shorter than pieces and separators, and one limit per group."""
    rows = [("a", i, "xyz"[: i % 4] * (i % 3)) for i in range(40)] + [("b", 0, ""), ("b", 1, ""), ("c", 0, "only")]
    df = spark.createDataFrame(rows, "source string, n int, t string").repartition(3)
    limits = spark.createDataFrame([("a", 5), ("b", 1), ("c", 100)], "source string, limit int")
    for limit in (1, 2, 7, 1000, limits):
        got = ordered_windows(df, ["source"], F.col("n"), F.col("t"), "--", limit).collect()
        for g in "abc":
            assert _joined(got, g)[1] == "--".join(t for s, _, t in rows if s == g)


def test_ordered_rank_matches_sorted(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "source string, path string, content string")
    got = {(r.source, r.path): r.rank for r in
           ordered_rank(df.withColumn("_parts", P.parts(F.col("path"))), ["source"], ["_parts", "path"],
                        partitions=5).collect()}
    for src in {"hot", "cold", "tiny"}:
        mine = sorted([r[1] for r in rows if r[0] == src], key=lambda p: (p.split("/"), p))
        assert [got[(src, p)] for p in mine] == list(range(1, len(mine) + 1))
