"""kNN against brute force, index lifecycle metamorphic checks, store, routing."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import routing as RT
from quarry.operators.knn import knn
from quarry.plans.indexing import build_index, retrieve, update_index
from quarry.sinks.index_store import IndexNotFound, IndexStore
from quarry.sources import corpus_views as V

SF = "/root/testdata/sf0.001"


def _brute(q, c, k):
    out = {}
    for i, qv in enumerate(q):
        d = [(float(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(qv, cv))), j) for j, cv in enumerate(c)]
        out[i] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("block,screen", [(None, 1024), (3, 1024), (None, 2)])
def test_knn_matches_brute_force(spark, block, screen):
    rng = np.random.default_rng(7)
    c = rng.integers(0, 3, size=(60, 4)).astype(np.float32)  # many exact ties
    q = rng.integers(0, 3, size=(7, 4)).astype(np.float32)
    cdf = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(c)], "id long, embedding array<float>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    hits = knn(cdf.repartition(4), qdf, 5, keys=["id"], query_block=block, screen_block=screen).collect()
    got = {}
    for r in hits:
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    expect = _brute(q, c, 5)
    for i in range(len(q)):
        assert [(d, j) for _, d, j in sorted(got[i])] == expect[i]


def test_knn_k_edges(spark):
    cdf = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    qdf = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert knn(cdf, qdf, 0, keys=["id"]).count() == 0
    assert knn(cdf, qdf, 10, keys=["id"]).count() == 2


def test_update_equals_rebuild_except_backdated(spark):
    base, head = V.files_base(spark, SF), V.files_head(spark, SF)
    updated, stats = update_index(build_index(base), head)
    rebuilt = build_index(head)
    backdated = head.where(F.col("doc_id") % 10 == 2).select(F.col("path").alias("file"))
    cols = ["file", "chunk_index", "text"]
    a = updated.join(backdated, "file", "left_anti").select(*cols)
    b = rebuilt.join(backdated, "file", "left_anti").select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # back-dated files keep their old (unchanged-content) rows
    old_rows = build_index(base).join(backdated, "file", "left_semi").select(*cols)
    assert updated.join(backdated, "file", "left_semi").select(*cols).exceptAll(old_rows).count() == 0
    s = stats.first()
    assert s.added + s.unchanged == updated.count()


def test_store_versions_and_missing(spark, tmpdir_fresh):
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "store"))
    assert not store.exists()
    with pytest.raises(IndexNotFound):
        store.load()
    idx = build_index(V.files_base(spark, SF))
    store.save(idx)
    store.save(idx.limit(3), tag="batch-1")
    assert store.versions() == [1, 2] and store.has_tag("batch-1") and not store.has_tag("batch-2")
    assert store.load().count() == 3


def test_retrieval_finds_inserted_passages(spark):
    """Benchmark passages are embedded in documents: the top hit for a query
    built from a passage is at distance no larger than any other chunk."""
    idx = build_index(V.files_base(spark, SF))
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    hits = retrieve(idx, q, 5)
    assert hits.where("rank = 1").count() == q.count()
    assert hits.groupBy("query_id").count().where("count > 5").count() == 0


def test_routing(spark):
    req = spark.createDataFrame([("fast",), ("coding",), ("unknown",), ("embedding",)], "purpose string")
    rt = RT.routes(spark, overrides={"fast": "tiny:0.5b"})
    got = {r.purpose: (r.model, r.num_ctx, r.num_predict) for r in RT.route_model(req, rt).collect()}
    assert got == {"fast": ("tiny:0.5b", 4096, 512), "coding": ("gemma4", 8192, 4096),
                   "unknown": ("gemma4", 8192, 4096), "embedding": ("nomic-embed-text", 8192, 4096)}


def test_catalog_facts_and_missing(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "tags.json")
    with open(path, "w") as fh:
        json.dump({"models": [{"name": "Gemma4:latest", "size": 3_500_000_000,
                               "modified_at": "2026-01-02T03:04:05Z"}]}, fh)
    cat = RT.model_catalog(spark, path)
    f = RT.model_facts(cat).first()
    assert (f.size_text, f.modified, f.base_name) == ("3.50 GB", "2026-01-02", "gemma4")
    miss = {r.purpose: (r.found_as, r.all_ok) for r in RT.missing_models(RT.configured_models(spark), cat).collect()}
    assert miss["default"] == ("Gemma4:latest", True)
    other = RT.missing_models(RT.configured_models(spark, {"fast": "qwen:0.5b"}), cat)
    assert {r.purpose: r.found_as for r in other.collect()}["fast"] is None
    empty = os.path.join(tmpdir_fresh, "empty.json")
    with open(empty, "w") as fh:
        json.dump({"models": []}, fh)
    assert RT.model_catalog(spark, empty).count() == 0


def test_model_embedder_plugs_into_build_and_retrieve(spark):
    """A model embedder (here a deterministic fake) replaces the hashed one."""
    from quarry.functions.embed import model_embedder

    def load():
        def embed(texts):
            return [[float(len(t) % 7), float(t.count("e")), 1.0] for t in texts]
        return embed

    emb = model_embedder(load)
    files = spark.createDataFrame([("a/x.py", 1.0, "eee"), ("a/y.py", 1.0, "e" * 10), ("a/z.py", 1.0, "abc")],
                                  "path string, mtime double, content string")
    idx = build_index(files, embed=emb)
    q = spark.createDataFrame([(1, "eee")], "query_id int, text string")
    hits = retrieve(idx, q, 2, embed=emb).orderBy("rank").collect()
    assert [h.file for h in hits] == ["a/x.py", "a/z.py"] and hits[0].distance == 0.0


def test_store_rejects_mixed_dimensions(spark, tmpdir_fresh):
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "mixed"))
    bad = spark.createDataFrame([("a", 0, "t", 1.0, [1.0, 2.0]), ("b", 0, "t", 1.0, [1.0])],
                                "file string, chunk_index int, text string, mtime double, embedding array<float>")
    with pytest.raises(ValueError):
        store.save(bad)
    assert not store.exists()


def _rows(df):
    return sorted((r.file, r.chunk_index, r.text, r.mtime, tuple(r.embedding)) for r in df.collect())


def test_delta_equals_rebuild_and_keeps_vectors(spark, tmpdir_fresh):
    from quarry.plans.indexing import index_delta
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "delta"))
    marked = build_index(V.files_base(spark, SF)).withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    store.save(marked)  # vectors that no rebuild would give
    head = V.files_head(spark, SF)
    want, _ = update_index(marked, head)
    store.save_delta(*index_delta(store.load(), head))
    assert _rows(store.load()) == _rows(want)
    kept = store.load().join(marked.select("file", "chunk_index", F.col("embedding").alias("old"), F.col("mtime").alias("m")), ["file", "chunk_index"]) \
        .where("mtime = m")
    assert kept.count() > 0 and kept.where("embedding != old").count() == 0
    store.compact()
    assert store.versions() == [1, 2, 3] and store.expire() == [1, 2]
    assert store.versions() == [3] and _rows(store.load()) == _rows(want)
    assert not os.path.exists(os.path.join(tmpdir_fresh, "delta", "data", "v=000001"))


def test_change_set_in_several_arrivals(spark, tmpdir_fresh):
    """No file goes because it has not arrived yet; deletes are explicit."""
    import time

    from quarry.streaming.index_updates import CHANGE_SCHEMA, update_from_stream
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "s"))
    files = [(f"a/f{i}.py", 1.0, f"text {i}") for i in range(5)]
    store.save(build_index(spark.createDataFrame(files, "path string, mtime double, content string")))
    inp, ck = os.path.join(tmpdir_fresh, "in"), os.path.join(tmpdir_fresh, "ck")
    for rows in ([("a/f0.py", 2.0, "new 0", "put"), ("a/f1.py", 0.5, "old 1", "put")],
                 [("a/f2.py", None, None, "delete"), ("a/f9.py", 1.0, "new 9", "put"), ("a/f9.py", 3.0, "newer 9", "put")],
                 [("a/f0.py", 3.0, "last 0", "put"), ("a/node_modules/x.py", 1.0, "no", "put")]):
        spark.createDataFrame(rows, CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(inp)
        time.sleep(0.05)
    update_from_stream(spark, store, inp, ck, files_per_batch=1)
    assert {r.file: r.text for r in store.load().collect()} == {
        "a/f0.py": "last 0", "a/f1.py": "text 1", "a/f3.py": "text 3", "a/f4.py": "text 4", "a/f9.py": "newer 9"}
    assert len(store.versions()) == 4


def test_two_streams_and_a_replay(spark, tmpdir_fresh):
    """Batch 0 of another stream is no replay of the first one's; a batch that
    was published but not committed is."""
    from quarry.streaming.index_updates import CHANGE_SCHEMA, update_from_stream
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "s"))
    store.save(build_index(spark.createDataFrame([("a.py", 1.0, "one")], "path string, mtime double, content string")))
    for name, file in (("x", "b.py"), ("y", "c.py")):
        inp, ck = os.path.join(tmpdir_fresh, name), os.path.join(tmpdir_fresh, name + "-ck")
        spark.createDataFrame([(file, 1.0, f"text of {file}", "put")], CHANGE_SCHEMA).coalesce(1).write.parquet(inp)
        update_from_stream(spark, store, inp, ck)
    assert {r.file for r in store.load().collect()} == {"a.py", "b.py", "c.py"} and len(store.versions()) == 3
    for name in ("0", ".0.crc"):
        os.remove(os.path.join(ck, "commits", name))  # as if the driver had died after publishing
    update_from_stream(spark, store, inp, ck)
    assert len(store.versions()) == 3 and store.load().count() == 3


def test_named_files_open_only_the_data_files_that_can_hold_them(spark, tmpdir_fresh):
    from quarry.plans.indexing import index_delta
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "s"))
    with pytest.raises(IndexNotFound):
        store.load_files(spark.createDataFrame([("x",)], "file string"))
    store.save(build_index(V.files_base(spark, SF)))
    store.save_delta(*index_delta(store.load(), V.files_head(spark, SF)))
    whole = store.load()
    every = set(whole.inputFiles())
    some = [r.file for r in whole.select("file").distinct().orderBy("file").limit(2).collect()]
    for names in (some, some[:1], ["not/there.py"], [], [r.file for r in whole.select("file").distinct().collect()]):
        df = spark.createDataFrame([(n,) for n in names], "file string")
        got = store.load_files(df)
        assert _rows(got) == _rows(whole.where(F.col("file").isin(names)))
        opened = {f for f in got.inputFiles() if "/data/" in f}
        assert opened <= every and (len(names) > 2 or len(opened) < len([f for f in every if "/data/" in f]))
    # retrieval reads texts so, and finds the same
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(1)
    hits = lambda df: sorted((r.query_id, r.rank, r.file, r.chunk_index, r.text) for r in df.collect())
    assert hits(store.search(q, 2)) == hits(retrieve(whole, q, 2))
    want = _rows(whole.where(F.col("file").isin(some)))
    store.compact()
    store.expire()
    assert _rows(store.load_files(spark.createDataFrame([(n,) for n in some], "file string"))) == want


def test_two_writers_with_the_same_number(spark, tmpdir_fresh, monkeypatch):
    """All see the same versions; each gets a number of its own and none is lost."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "s"))
    files = lambda *names: spark.createDataFrame([(n, 1.0, f"text {n}") for n in names], "path string, mtime double, content string")
    store.save(build_index(files("a.py")))
    meet, plain = Barrier(4), IndexStore._claim
    monkeypatch.setattr(IndexStore, "_claim", lambda self: (meet.wait(), plain(self))[1])

    def write(i):
        rows = build_index(files(f"w{i}.py"))
        IndexStore(spark, store.path).save_delta(rows, rows.select("file"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    assert len(store.versions()) == 5
    assert {r.file for r in store.load().collect()} == {"a.py", *(f"w{i}.py" for i in range(4))}


def test_each_distinct_text_is_embedded_once(spark, tmpdir_fresh):
    """Over build, update and stream: moved, renamed and equal texts cost no call."""
    from quarry.functions.embed import model_embedder
    from quarry.plans.indexing import index_delta
    from quarry.sinks.vector_cache import VectorCache
    from quarry.streaming.index_updates import CHANGE_SCHEMA, update_from_stream
    seen = os.path.join(tmpdir_fresh, "seen")
    os.mkdir(seen)

    def load():
        def embed(texts):
            for t in texts:
                with open(os.path.join(seen, t), "a") as f:
                    f.write("x")
            return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]
        return embed

    calls = lambda: {t: os.path.getsize(os.path.join(seen, t)) for t in os.listdir(seen)}
    cache = VectorCache(spark, os.path.join(tmpdir_fresh, "vectors"), "fake", model_embedder(load))
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "store"))
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, mtime double, content string")
    store.save(build_index(files(("a.py", 1.0, "one"), ("b.py", 1.0, "one"), ("c.py", 1.0, "three")), embed=cache))
    assert calls() == {"one": 1, "three": 1}
    # c moves to d, b changes to a's old text plus a new file
    head = files(("a.py", 1.0, "one"), ("b.py", 2.0, "three"), ("d.py", 2.0, "three"), ("e.py", 2.0, "five"))
    store.save_delta(*index_delta(store.load(), head, embed=cache))
    assert calls() == {"one": 1, "three": 1, "five": 1}
    inp = os.path.join(tmpdir_fresh, "in")
    spark.createDataFrame([("a.py", 3.0, "five", "put"), ("f.py", 3.0, "six", "put"), ("g.py", 3.0, "six", "put")], CHANGE_SCHEMA).write.parquet(inp)
    update_from_stream(spark, store, inp, os.path.join(tmpdir_fresh, "ck"), embed=cache)
    assert calls() == {"one": 1, "three": 1, "five": 1, "six": 1}
    got = {r.file: (r.text, tuple(r.embedding)) for r in store.load().collect()}
    text = {"a.py": "five", "b.py": "three", "d.py": "three", "e.py": "five", "f.py": "six", "g.py": "six"}
    assert got == {f: (t, (float(len(t)), float(t.count("e")), 1.0)) for f, t in text.items()}
    hits = retrieve(store.load(), spark.createDataFrame([(1, "six")], "query_id int, text string"), 2, embed=cache).orderBy("rank").collect()
    assert [h.file for h in hits] == ["f.py", "g.py"] and hits[0].distance == 0 and calls()["six"] == 1


def test_ignored_files_are_not_indexed(spark):
    from quarry.operators.scan import ignore_patterns
    files = spark.createDataFrame([("r/a.py", None, "x"), ("r/gen/b.py", 1.0, "y"), ("q/gen/c.py", 1.0, "z")], "path string, mtime double, content string")
    pats = ignore_patterns(spark, spark.createDataFrame([("r/gen/*",)], "line string"))
    idx = build_index(files, patterns=pats)
    assert {r.file for r in idx.collect()} == {"r/a.py", "q/gen/c.py"}
    merged, _ = update_index(build_index(files), files, patterns=pats)
    assert {r.file for r in merged.collect()} == {"r/a.py", "q/gen/c.py"}  # a NULL mtime is no deletion
