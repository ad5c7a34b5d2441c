"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected). The index is built once, written as Parquet, and the
retrieval queries read it back, as a deployment would. Session start-up (JVM
and Python worker warm-up on a one-row job) is not timed. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quarry import constants as K  # noqa: E402
from quarry.functions.embed import hashed_embedding  # noqa: E402
from quarry.operators import changes as CH  # noqa: E402
from quarry.operators import corpus as CO  # noqa: E402
from quarry.operators import responses as RS  # noqa: E402
from quarry.operators import scan as SC  # noqa: E402
from quarry.operators.knn import knn  # noqa: E402
from quarry.plans import catalog as C  # noqa: E402
from quarry.plans.indexing import build_index, index_delta  # noqa: E402
from quarry.session import build_session, scratch_path  # noqa: E402
from quarry.sinks.index_store import IndexStore  # noqa: E402
from quarry.sources import corpus_views as V  # noqa: E402
from quarry.sources.tables import table  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="quarry-bench")
    times: dict[str, float] = {}
    warm = spark.range(8).select(hashed_embedding(F.lit("warm up")).alias("v"))
    warm.write.format("noop").mode("overwrite").save()

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    store = IndexStore(spark, scratch_path(spark, "bench-index"))
    timed("build_index", lambda: store.save(build_index(V.files_base(spark, sf_dir))))
    timed("retrieve", lambda: run(store.search(C.benchmark_questions(spark, sf_dir), K.TOP_K)))
    timed("update_index", lambda: store.save_delta(*index_delta(store.load(), V.files_head(spark, sf_dir))))
    timed("knn_embeddings", lambda: run(knn(table(spark, sf_dir, "embeddings"),
                                           C.label_exemplars(spark, sf_dir), K.TOP_K, keys=["vec_id"])))
    timed("concat_corpus", lambda: run(CO.concat_corpus(SC.scan_code_files(V.files_base(spark, sf_dir)))))
    timed("analyze_map_reduce", lambda: run(C.q_analyze_map_reduce(spark, sf_dir)))
    for job in ("audit", "review", "generate_docs", "generate_tests", "ask"):
        timed(job, lambda job=job: run(C.QUERIES[job](spark, sf_dir)))
    timed("split_reasoning", lambda: run(RS.split_reasoning(V.tokens(spark, sf_dir))))
    timed("parse_response_lines", lambda: run(RS.parse_response_lines(V.response_lines(spark, sf_dir))))
    timed("apply_patches", lambda: run(C.q_apply_patches(spark, sf_dir)))
    timed("changed_lines", lambda: run(CH.changed_lines(V.files_base(spark, sf_dir), V.files_head(spark, sf_dir))))
    timed("sort_paths", lambda: run(CO.sort_paths(V.files_base(spark, sf_dir))))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).replace("sf", ""),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
