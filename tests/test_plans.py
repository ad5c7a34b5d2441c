"""Physical-plan properties the scale design relies on."""


from quarry.operators import corpus as CO
from quarry.operators import scan as SC
from quarry.plans import catalog as C
from quarry.plans.indexing import build_index, retrieve
from quarry.session import scratch_path
from quarry.sinks.index_store import IndexStore
from quarry.sources import corpus_views as V

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_retrieval_plan(spark):
    from quarry.plans.indexing import embed_queries
    from quarry.operators.knn import knn
    store = IndexStore(spark, scratch_path(spark, "plan-test"))
    store.save(build_index(V.files_base(spark, SF)))
    idx = store.load()
    # text and vectors are read by separate scans; the hits join the text by key
    lookup = _plan(retrieve(idx, C.benchmark_questions(spark, SF), 5))
    text_scans = [l for l in lookup.split("\n") if "FileScan parquet" in l and "text" in l.split("ReadSchema")[1]]
    assert text_scans and not any("embedding" in l.split("ReadSchema")[1] for l in text_scans)
    plan = _plan(knn(idx, embed_queries(C.benchmark_questions(spark, SF)), 5, keys=["file", "chunk_index"]))
    # per-task top-k before the shuffle, global top-k after it
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan
    # the corpus is scanned, never broadcast (queries travel as a broadcast variable)
    assert "BroadcastExchange" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the vector scan reads only key + vector columns
    vec_scans = [l for l in plan.split("\n") if "FileScan parquet" in l and "embedding" in l]
    assert vec_scans and all("text" not in l for l in vec_scans)


def test_corpus_windows_never_gather_a_root(spark):
    """Texts are exchanged by their own key and by (root, window), no window
    function runs over a whole root's rows, and the root alone is a key only
    of per-range sums."""
    plan = _plan(CO.concat_corpus(SC.scan_code_files(V.files_base(spark, SF))))
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert any("source" in e and "window" in e for e in exchanges)
    assert "_pid" in plan and "row_number" not in plan


def test_scan_filters_reach_the_scan(spark):
    df = SC.scan_index_files(V.files_base(spark, SF)).select("path")
    plan = _plan(df)
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l][0]
    assert "arrays_overlap" in scan  # the ignore-folder predicate is a data filter of the scan
    assert "text" not in scan.split("ReadSchema")[1]  # content is pruned away for a path-only query


def test_patch_fold_is_one_expression(spark):
    plan = _plan(C.q_apply_patches(spark, SF))
    assert not any(x in plan for x in ("PythonUDF", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"))


def test_delta_reads_two_index_columns_and_writes_only_changes(spark):
    from quarry.plans.indexing import index_delta
    from quarry.sinks.index_store import IndexStore
    store = IndexStore(spark, scratch_path(spark, "delta"))
    store.save(build_index(V.files_base(spark, SF)))
    rows, removed = index_delta(store.load(), V.files_head(spark, SF))
    for frame in (rows, removed):
        schemas = [part.split(">")[0] for part in _plan(frame).split("ReadSchema")[1:]]
        assert schemas and not any("embedding" in x or "chunk_index" in x for x in schemas)
    store.save_delta(rows, removed)
    changed = {r.file for r in removed.collect()}
    written = spark.read.parquet(f"{store.path}/data/v=000002")
    assert {r.file for r in written.select("file").distinct().collect()} <= changed
    assert written.count() < store.load().count()


def test_global_ignore_patterns_are_a_filter_not_a_join(spark):
    plan = _plan(C.mapped_corpus(spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
