"""Write the physical plans of the headline jobs to PLANS.md.

Usage: ``python -m quarry.checks.plans [sf_dir] [out.md]``. Plans are the
executed (AQE) plans after one run, so they show the final join and
partitioning choices.
"""

from __future__ import annotations

import os
import sys

from quarry import constants as K
from quarry.operators import corpus as CO
from quarry.operators import responses as RS
from quarry.operators import scan as SC
from quarry.plans import catalog as C
from quarry.plans.indexing import build_index, retrieve, update_index
from quarry.session import build_session, scratch_path
from quarry.sinks.index_store import IndexStore
from quarry.sources import corpus_views as V

NOTES = {
    "retrieve (stored index)": "Vector scan reads only (file, chunk_index, embedding); per-task top-k in "
                               "MapInPandas, WindowGroupLimit Partial before and Final after the only "
                               "shuffle; hits broadcast back onto a (file, chunk_index, text) scan.",
    "update_index": "One (file, mtime) aggregate over the index, file-status join on light rows, semi "
                    "join for kept rows; only changed files reach chunking and the embedding UDF.",
    "concat_corpus": "Character offsets from range-partitioned keys and lengths; texts joined to their "
                     "offsets, cut at window borders and gathered by (root, window).",
    "split_reasoning": "One shuffle by response_id; running flag and ordered collect per response.",
    "apply_patches": "Patches and files are dealt by file once; one aggregate per (answer, file), one join with the "
                     "file's text and the whole fold as one expression; no Python.",
    "review prompts (own root)": "Windows and question vectors are written first; cells of one root's questions and chunks "
                                 "meet by cogroup, top-k per cell, then per question; hits join the text by key.",
    "write_patched": "Answers' patches ranked per file by sorted ranges, folded in rounds, joined with the untouched files.",
}


def _tree(df) -> str:
    df.collect()  # results are small; running this DataFrame's own execution finalises its AQE plan
    return df._jdf.queryExecution().executedPlan().toString()


def main(sf_dir: str, out: str):
    spark = build_session("local[8]")
    store = IndexStore(spark, scratch_path(spark, "plans-index"))
    store.save(build_index(V.files_base(spark, sf_dir)))
    jobs = {
        "retrieve (stored index)": retrieve(store.load(), C.benchmark_questions(spark, sf_dir), K.TOP_K),
        "update_index": update_index(store.load(), V.files_head(spark, sf_dir))[0],
        "concat_corpus": CO.concat_corpus(SC.scan_code_files(V.files_base(spark, sf_dir))),
        "split_reasoning": RS.split_reasoning(V.tokens(spark, sf_dir)),
        "apply_patches": C.q_apply_patches(spark, sf_dir),
        "review prompts (own root)": C.q_prompt_review(spark, sf_dir),
        "write_patched": C.q_write_patched(spark, sf_dir),
    }
    parts = [f"# Physical plans ({os.path.basename(sf_dir)}, local[8], AQE final plans)\n",
             "Generated by `python -m quarry.checks.plans`.\n"]
    for name, df in jobs.items():
        parts.append(f"## {name}\n\n{NOTES[name]}\n\n```\n{_tree(df)}\n```\n")
    with open(out, "w") as fh:
        fh.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01",
         sys.argv[2] if len(sys.argv) > 2 else "PLANS.md")
