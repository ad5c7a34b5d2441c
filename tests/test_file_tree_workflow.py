"""End to end on a real directory: build, edit the tree, update, search."""

import os
import time

from pyspark.sql import functions as F

from quarry.plans.indexing import build_index, retrieve, update_index
from quarry.sinks.index_store import IndexStore
from quarry.sources.files import read_tree


def _write(root, rel, text, mtime=None):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    if mtime is not None:
        os.utime(path, (mtime, mtime))


def test_index_update_search_on_a_tree(spark, tmpdir_fresh):
    root = os.path.join(tmpdir_fresh, "repo")
    t0 = time.time() - 1000
    _write(root, "src/keep.py", "def keep():\n    return 'stable'\n" * 80, t0)       # 2 chunks+
    _write(root, "src/change.py", "alpha beta gamma\n" * 10, t0)
    _write(root, "src/gone.py", "to be deleted\n", t0)
    _write(root, "src/backdated.py", "old words here\n", t0)
    _write(root, "node_modules/dep.js", "ignored\n", t0)
    store = IndexStore(spark, os.path.join(tmpdir_fresh, "store"))
    store.save(build_index(read_tree(spark, root)))
    before = {r.file: r.n for r in store.load().groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(before) == {"src/keep.py", "src/change.py", "src/gone.py", "src/backdated.py"}

    _write(root, "src/change.py", "zeta eta theta\n" * 10, t0 + 500)      # newer: re-indexed
    os.remove(os.path.join(root, "src/gone.py"))                         # deleted
    _write(root, "src/new.ts", "brand new file\n", t0 + 500)             # added
    _write(root, "src/backdated.py", "new words now\n", t0 - 500)       # older mtime: kept as is
    merged, stats = update_index(store.load(), read_tree(spark, root))
    store.save(merged)
    s = stats.first()
    idx = store.load()
    texts = {r.file: r.text for r in idx.where("chunk_index = 0").collect()}
    assert set(texts) == {"src/keep.py", "src/change.py", "src/new.ts", "src/backdated.py"}
    assert texts["src/change.py"].startswith("zeta") and texts["src/backdated.py"] == "old words here\n"
    assert s.added == 2 and s.removed == before["src/change.py"] + before["src/gone.py"]
    assert s.unchanged == before["src/keep.py"] + before["src/backdated.py"]
    assert store.versions() == [1, 2]

    q = spark.createDataFrame([(1, "zeta eta theta")], "query_id int, text string")
    top = retrieve(idx, q, 1).first()
    assert top.file == "src/change.py" and top.rank == 1
