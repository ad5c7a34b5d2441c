"""Every stage of the pipeline against a plain version of it."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm import toxicity
from tests.llm.test_decontamination import brute_force as contaminated_rows
from tests.llm.test_neardup import brute_force as near_copies
from tests.llm.test_substrings import brute_force as without_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    frames, current = [], docs
    for name, stage in cp.STAGES:
        assert name and callable(stage)
        current = stage(spark, current, SF)
        if name != cp.STAGES[-1][0]:
            assert current.dtypes == docs.dtypes
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        current.write.mode("overwrite").parquet(path)
        current = spark.read.parquet(path)
        frames.append(current.collect())
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id for r in frames[0]} == {d for d, s in scores.items() if s < cp.TOXIC}
    groups = near_copies([(r.doc_id, r.text) for r in frames[0]], 5, 80)
    assert {str(r.doc_id) for r in frames[1]} == {d for d, _, c in groups if d == c}
    assert all(r == before[r.doc_id] for r in frames[1])
    kept = {d: (gone, text) for d, _, gone, text in without_repeats([(r.doc_id, r.text) for r in frames[1]], 20)}
    for r in frames[2]:
        gone, text = kept[str(r.doc_id)]
        assert r.text == (text if gone else before[r.doc_id].text) and r.n_chars == len(r.text)
    assert len(frames[2]) == len(frames[1]) and any(gone for gone, _ in kept.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = contaminated_rows([(r.doc_id, r.text) for r in frames[2]], items, 13)
    assert {str(r.doc_id) for r in frames[3]} == {d for d, n, hit, _ in hits if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in frames[4]} == {r.doc_id for r in frames[3]}
    assert sorted((r.doc_id, r.ids) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.ids) for r in frames[4])


def test_odd_rows(spark):
    rows = [(1, None, "en", 0, "a"), (1, None, "en", 0, "a"), (2, "", None, 0, None), (None, "x y z", "en", 5, "k"), (None, "x y z", "en", 5, "k"),
            (3, "x  y\nz", "en", 6, "k"), (4, "w " * 30_000, "en", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, kept string")
    for part, want in ((docs, 6), (docs.limit(0), 0)):
        for name, stage in cp.STAGES:
            part = stage(spark, part, SF)
        assert part.count() == (want - 1 if want else 0)


def test_further_columns_of_any_name(spark):
    """Names that the stages use themselves, and names that need quoting."""
    names = ["cut_", "a.b", "x`y", "kept", "row_", "h_", "id_", "n_chars", "factors", "spans", "score", "base", "place"]
    docs = spark.createDataFrame([(i, f"word{i} other{i} third{i}", *[f"{i}-{c}" for c in names]) for i in range(3)],
                                 ["doc_id", "text", *names]).withColumn("n_chars", F.length("text").cast("long"))
    part = docs
    for name, stage in cp.STAGES[:-1]:
        part = stage(spark, part, SF)
        assert part.columns == docs.columns, name
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, docs.collect())), name
    assert cp.STAGES[-1][1](spark, part, SF).count() == 3
