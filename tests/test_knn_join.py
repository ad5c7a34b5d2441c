"""The distributed nearest-neighbour join against brute force."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import knn_join as KJ
from quarry.operators.knn import knn
from quarry.plans.indexing import build_index, retrieve, root_of

C_SCHEMA = "root string, id long, embedding array<float>"
Q_SCHEMA = "root string, query_id long, embedding array<float>"


def brute(corpus, queries, k, grouped=True):
    out = {}
    for root, q, qv in queries:
        # summed in the order of the dimensions
        d = [(float(np.cumsum((np.float32(qv).astype(float) - np.float32(cv).astype(float)) ** 2)[-1]), i)
             for r, i, cv in corpus if cv is not None and qv is not None and (not grouped or (r == root and r is not None))]
        if d:
            out[q] = sorted(d)[:k]
    return out


def run(spark, corpus, queries, k, grouped=True, **sizes):
    c = spark.createDataFrame(corpus, C_SCHEMA).repartition(5)
    q = spark.createDataFrame(queries, Q_SCHEMA).repartition(3)
    groups = {"corpus_group": F.col("root"), "query_group": F.col("root")} if grouped else {}
    got = {}
    for r in KJ.knn_join(c, q, k, ["id"], **groups, **sizes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def grid(rng, root, n, first, dim=4):
    return [(root, first + i, rng.integers(0, 3, dim).astype(float).tolist()) for i in range(n)]  # many exact ties


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 7, "query_rows": 3}, {"cell_rows": 40, "query_rows": 1000}])
def test_per_root_with_one_hot_root(spark, sizes):
    rng = np.random.default_rng(3)
    corpus = grid(rng, "hot", 300, 0) + grid(rng, "b", 9, 400) + grid(rng, "c", 3, 500) + grid(rng, "unasked", 20, 600)
    corpus += [("b", 700, None), (None, 701, [0.0] * 4)]
    queries = grid(rng, "hot", 40, 0) + grid(rng, "b", 4, 100) + grid(rng, "c", 2, 200) + grid(rng, "empty", 2, 300)
    queries += [("b", 400, None), (None, 401, [0.0] * 4)]
    assert run(spark, corpus, queries, 5, **sizes) == brute(corpus, queries, 5)


def test_equal_vectors_and_real_values(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=6).tolist()
    corpus = [("a", i, same) for i in range(60)] + [("a", 100 + i, rng.normal(size=6).tolist()) for i in range(60)]
    queries = [("a", i, rng.normal(size=6).tolist()) for i in range(7)] + [("a", 50, same)]
    for grouped in (True, False):
        assert run(spark, corpus, queries, 4, grouped, cell_rows=10, query_rows=2) == brute(corpus, queries, 4, grouped)


def test_no_rows(spark):
    some = [("a", 1, [0.0, 1.0])]
    assert run(spark, some, [], 3) == run(spark, [], some, 3) == run(spark, some, some, 0) == {}


def clusters(rng, n):
    return [("a", i, (np.eye(8)[i % 8] * 50 + rng.normal(size=8)).tolist()) for i in range(n)]


def test_parts_that_hold_no_neighbour_are_skipped(spark):
    rng = np.random.default_rng(5)
    corpus, queries = clusters(rng, 400), clusters(rng, 30)
    c = spark.createDataFrame(corpus, C_SCHEMA).select(F.col("root").alias("_g"), "id", F.col("embedding").alias("_v"))
    q = spark.createDataFrame(queries, Q_SCHEMA).select(F.col("root").alias("_g"), "query_id", F.col("embedding").alias("_q"))
    pivots = KJ.choose_pivots(c, ["id"], 400, 16)
    sizes = spark.createDataFrame([("a", len(pivots))], "_g string, parts int")
    assigned = KJ.assign(c, sizes, pivots)
    visits = [len(r.visits) for r in KJ.query_visits(q, KJ.rings(assigned, 5), pivots).collect()]
    parts = assigned.select("pivot").distinct().count()
    assert len(visits) == 30 and parts > 8 and sum(visits) < 0.5 * 30 * parts
    assert run(spark, corpus, queries, 5, cell_rows=25, query_rows=10) == brute(corpus, queries, 5)


def test_no_query_passes_the_driver(spark, monkeypatch):
    """What is collected: two sums, and at most as many vectors as pivots."""
    rng = np.random.default_rng(6)
    c, q = spark.createDataFrame(grid(rng, "a", 200, 0), C_SCHEMA), spark.createDataFrame(grid(rng, "a", 50, 0), Q_SCHEMA)
    seen, plain = [], DataFrame.collect
    kind = type(c)

    def collect(self):
        rows = kind.__dict__["_collect"](self)
        seen.append((self.columns, len(rows)))
        return rows

    plain = kind.collect
    monkeypatch.setattr(kind, "_collect", plain, raising=False)
    monkeypatch.setattr(kind, "collect", collect)
    out = KJ.knn_join(c, q, 5, ["id"], corpus_group=F.col("root"), query_group=F.col("root"), cell_rows=20)
    assert all(n <= KJ.MOST_PIVOTS and not any("_q" in x or "query" in x for x in cols) for cols, n in seen) and seen
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_large_query_sets_are_joined(spark):
    rng = np.random.default_rng(8)
    corpus, queries = grid(rng, "a", 60, 0), grid(rng, "a", 12, 0)
    c, q = spark.createDataFrame(corpus, C_SCHEMA), spark.createDataFrame(queries, Q_SCHEMA)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(knn(c, q, 5, ["id"], query_block=5)) == rows(knn(c, q, 5, ["id"]))


def test_retrieval_stays_within_the_root(spark):
    files = spark.createDataFrame([("a/x.py", 1.0, "red green"), ("b/y.py", 1.0, "red green blue"), ("b/z.py", 1.0, "black")],
                                  "path string, mtime double, content string")
    asked = spark.createDataFrame([(1, "red green", "b"), (2, "red", "a"), (3, "red", "c")], "query_id int, text string, root string")
    hits = retrieve(build_index(files), asked, 5, index_root=root_of(F.col("file"))).collect()
    assert sorted((h.query_id, h.rank, h.file) for h in hits) == [(1, 1, "b/y.py"), (1, 2, "b/z.py"), (2, 1, "a/x.py")]


def test_jobs_ask_with_the_embedder_of_the_index(spark):
    from quarry.functions.embed import model_embedder
    from quarry.plans import jobs as JB

    def load():
        return lambda texts: [[float(t.count("q")), 1.0] for t in texts]

    emb = model_embedder(load)
    files = spark.createDataFrame([("a/x.py", 1.0, "qqq"), ("a/y.py", 1.0, "none"), ("b/z.py", 1.0, "qqq")], "path string, mtime double, content string")
    windows = spark.createDataFrame([("a", 0, 1, "qqq in the change"), ("c", 0, 1, "q")], "source string, window long, n_windows long, diff string")
    out = {r.source: r.system for r in JB.review_prompts(windows, build_index(files, embed=emb), embed=emb).collect()}
    assert "Chunk 1 (file: a/x.py)" in out["a"] and "b/z.py" not in out["a"] and "Chunk" not in out["c"]


def test_equal_questions_are_asked_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    corpus = grid(rng, "a", 60, 0) + grid(rng, "b", 30, 100)
    queries = [(root, i + 100 * j, [float(i % 3), 1.0, 0.0, 2.0]) for j, root in enumerate("ab") for i in range(40)]
    asked, plain = [], KJ.write_snapshot
    monkeypatch.setattr(KJ, "write_snapshot", lambda df, name, **kw: (out := plain(df, name, **kw), asked.append((name, out)))[0])
    for sizes in ({}, {"cell_rows": 7, "query_rows": 2}):
        assert run(spark, corpus, queries, 5, **sizes) == brute(corpus, queries, 5)
    assert [df.count() for name, df in asked if name == "knn-asked"] == [6, 6]


def test_ties_are_screened_a_bounded_number_at_a_time(monkeypatch):
    import pandas as pd

    from quarry.operators import knn as KN
    seen, plain = [], KN._exact
    monkeypatch.setattr(KN, "_exact", lambda q, c: (seen.append(len(q)), plain(q, c))[1])
    corpus = pd.DataFrame({"id": range(6000), "embedding": [np.ones(4, np.float32)] * 6000})
    batches = iter([corpus.iloc[:4500], corpus.iloc[4500:]])
    (out,) = KN.top_k_blocks(np.arange(9), np.zeros((9, 4), np.float32), 3, ["id"], "embedding", batches)
    assert max(seen) <= KN.PAIRS < sum(seen)
    assert out.sort_values(["query_id", "id"])[["query_id", "id", "distance"]].values.tolist() == [[q, i, 4.0] for q in range(9) for i in range(3)]


def test_embedding_memory_does_not_follow_the_batch(monkeypatch):
    import pyarrow as pa

    from quarry.functions import embed as EM
    made, plain = [], np.bincount
    monkeypatch.setattr(EM.np, "bincount", lambda *a, minlength: (made.append(minlength), plain(*a, minlength=minlength))[1])
    tokens = [["a", f"b{i}", "a"] if i % 7 else None for i in range(5000)]
    whole = EM._densify(16).func(pa.array(tokens, pa.list_(pa.string()))).to_pylist()
    assert max(made) <= EM.SLICE_TEXTS * 16 and sum(made) == 5000 * 16
    assert whole[4999] == EM._densify(16).func(pa.array([tokens[4999]], pa.list_(pa.string()))).to_pylist()[0] and whole[0] == [0.0] * 16
