"""Registered queries: one per operator key, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or views Spark derives from them) in
full; limits appear only where top-k is the operator itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.operators.chunking import chunk_text
from quarry.operators.knn import knn
from quarry.operators.scan import scan_index_files
from quarry.plans.indexing import build_index, retrieve
from quarry.sources import corpus_views as V
from quarry.functions import prompts as PR
from quarry.functions import text as TX
from quarry.operators import changes as CH
from quarry.operators import context as CX
from quarry.operators import corpus as CO
from quarry.operators import index_ops as IX
from quarry.operators import patches as PT
from quarry.operators import responses as RS
from quarry.operators import routing as RT
from quarry.operators import scan as SC
from quarry.operators.generate import generate_tokens
from quarry.plans import jobs as JB
from quarry.plans.indexing import index_delta, update_index
from quarry.session import scratch_path
from quarry.sinks.index_store import IndexStore
from quarry.sinks.tables import write_snapshot
from quarry.streaming import index_updates as XU
from quarry.streaming import reasoning as XR
from quarry.streaming.token_source import PromptQueue, token_stream
from quarry.sources.tables import table

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text")


def label_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the label's lowest-id vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"),
                                  F.min("vec_id").alias("query_id")).select("query_id", "embedding")


# ---------------------------------------------------------------- scans -----
@register("scan_index_files")
def q_scan_index_files(spark, sf_dir):
    return scan_index_files(V.files_base(spark, sf_dir)).select("path", "mtime", "source")


# ----------------------------------------------------- table functions -----
@register("chunk_text")
def q_chunk_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return chunk_text(d, "text", keep=["doc_id"])


# ------------------------------------------------------------ embedding -----
@register("embed_chunks")
def q_embed_chunks(spark, sf_dir):
    idx = build_index(V.files_base(spark, sf_dir))
    return idx.select("file", "chunk_index", F.posexplode("embedding").alias("bucket", "weight")) \
        .where(F.col("weight") != 0)


# ---------------------------------------------------------------- joins -----
@register("knn")
def q_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = knn(e, label_exemplars(spark, sf_dir), K.TOP_K, keys=["vec_id"])
    return hits.select("query_id", "vec_id", "rank", "distance")


@register("top_k")
def q_top_k(spark, sf_dir):
    """One query (the lowest-id vector), ordered and limited."""
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("query_id"), "embedding")
    return knn(e, q, K.TOP_K, keys=["vec_id"]).select("vec_id", "distance", "rank")


# ------------------------------------------------------------ composite -----
@register("retrieve")
def q_retrieve(spark, sf_dir):
    idx = build_index(V.files_base(spark, sf_dir))
    return retrieve(idx, benchmark_questions(spark, sf_dir), K.TOP_K)


# ------------------------------------------------- scan family (batch 2) -----

# Ignore-file lines used by the pattern queries (a small inline table).
IGNORE_LINES = ["# generated files", "", "  *.kt  ", "src1*", "*/f1?.ts", "docs/", "*/docs/f2*",
                "*/f[0-3][!0-7].js", "[x.py", "src0/*/f*[]5].md"]


def ignore_lines_df(spark):
    return spark.createDataFrame([(x,) for x in IGNORE_LINES], "line string")


@register("scan_code_files")
def q_scan_code_files(spark, sf_dir):
    return SC.scan_code_files(V.files_base(spark, sf_dir)).select("path", "mtime", "source")


@register("scan_mapped_files")
def q_scan_mapped_files(spark, sf_dir):
    pats = SC.ignore_patterns(spark, ignore_lines_df(spark))
    return SC.scan_mapped_files(V.files_base(spark, sf_dir), pats).select("path", "source")


@register("read_text")
def q_read_text(spark, sf_dir):
    return SC.read_text(V.with_carriage_returns(V.files_base(spark, sf_dir))).select("path", "content")


@register("ignored_dirs")
def q_ignored_dirs(spark, sf_dir):
    return SC.ignored_dirs(V.files_base(spark, sf_dir)).select("path", "ignored")


@register("ignore_patterns")
def q_ignore_patterns(spark, sf_dir):
    pats = SC.ignore_patterns(spark, ignore_lines_df(spark))
    return SC.drop_ignored(V.files_base(spark, sf_dir), pats).select("path")


@register("drop_blank")
def q_drop_blank(spark, sf_dir):
    return SC.drop_blank(V.with_blanks(table(spark, sf_dir, "documents")), "text").select("doc_id")


@register("oversized")
def q_oversized(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return SC.oversized(d, "text").select("doc_id", "oversized")


@register("suppress_lines")
def q_suppress_lines(spark, sf_dir):
    d = V.with_markers(table(spark, sf_dir, "documents"))
    return SC.suppress_lines(d, "text").select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("path_facts")
def q_path_facts(spark, sf_dir):
    return CO.path_facts(V.files_base(spark, sf_dir))


@register("sort_paths")
def q_sort_paths(spark, sf_dir):
    return CO.sort_paths(V.files_base(spark, sf_dir))


@register("language_of")
def q_language_of(spark, sf_dir):
    return CO.language_of(V.files_base(spark, sf_dir))


@register("test_path")
def q_test_path(spark, sf_dir):
    return CO.test_path(SC.scan_mapped_files(V.files_base(spark, sf_dir)))


@register("dominant_language")
def q_dominant_language(spark, sf_dir):
    return CO.dominant_language(V.files_base(spark, sf_dir))


@register("concat_corpus")
def q_concat_corpus(spark, sf_dir):
    return CO.concat_corpus(SC.scan_code_files(V.files_base(spark, sf_dir)))


def root_targets(spark, sf_dir):
    """Each corpus root as a documentation target (directory mode: stem = root name)."""
    return V.files_base(spark, sf_dir).select("source").distinct().withColumn("stem", F.col("source"))


@register("doc_jobs")
def q_doc_jobs(spark, sf_dir):
    return CO.doc_jobs(root_targets(spark, sf_dir)).select(
        "source", "type_order", "doc_type", "label", "dest_path")


@register("truncate_payload")
def q_truncate_payload(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    payload, cut = TX.truncate_payload(F.col("text"))
    return d.select("doc_id", payload.alias("payload"), cut.alias("truncated"))


@register("truncate_file")
def q_truncate_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.truncate(F.col("text"), K.MAX_FILE_CHARS, K.TRUNCATED_MARKER).alias("content"),
                    (F.length("text") > K.MAX_FILE_CHARS).alias("truncated"))


# ------------------------------------------------- index lifecycle (3) -----


def base_index(spark, sf_dir):
    return build_index(V.files_base(spark, sf_dir))


def head_current(spark, sf_dir):
    return scan_index_files(V.files_head(spark, sf_dir)).select("path", "mtime", "content")


@register("latest_mtime")
def q_latest_mtime(spark, sf_dir):
    return IX.latest_mtime(base_index(spark, sf_dir))


@register("files_deleted")
def q_files_deleted(spark, sf_dir):
    return IX.files_deleted(base_index(spark, sf_dir), head_current(spark, sf_dir))


@register("files_new_or_changed")
def q_files_new_or_changed(spark, sf_dir):
    return IX.files_new_or_changed(base_index(spark, sf_dir), head_current(spark, sf_dir)) \
        .select("file", "mtime")


@register("chunks_kept")
def q_chunks_kept(spark, sf_dir):
    return IX.chunks_kept(base_index(spark, sf_dir), head_current(spark, sf_dir)) \
        .select("file", "chunk_index", "mtime")


@register("files_except")
def q_files_except(spark, sf_dir):
    old = base_index(spark, sf_dir).select("file")
    cur = head_current(spark, sf_dir).select(F.col("path").alias("file"))
    return IX.files_except(old, cur)


@register("merge_index")
def q_merge_index(spark, sf_dir):
    merged, _ = update_index(base_index(spark, sf_dir), V.files_head(spark, sf_dir))
    return merged.select("file", "chunk_index", "mtime", F.length("text").alias("n_chars"))


@register("distinct_files")
def q_distinct_files(spark, sf_dir):
    merged, _ = update_index(base_index(spark, sf_dir), V.files_head(spark, sf_dir))
    return IX.distinct_files(merged)


@register("index_stats")
def q_index_stats(spark, sf_dir):
    _, stats = update_index(base_index(spark, sf_dir), V.files_head(spark, sf_dir))
    return stats


@register("embed_progress")
def q_embed_progress(spark, sf_dir):
    return IX.embed_progress(base_index(spark, sf_dir))


@register("build_index")
def q_build_index(spark, sf_dir):
    idx = base_index(spark, sf_dir)
    return idx.select("file", "chunk_index", "mtime", "text", F.size("embedding").alias("dim"))


@register("update_index")
def q_update_index(spark, sf_dir):
    merged, _ = update_index(base_index(spark, sf_dir), V.files_head(spark, sf_dir))
    return merged.select("file", "chunk_index", "mtime", "text", F.size("embedding").alias("dim"))


@register("save_index")
def q_save_index(spark, sf_dir):
    """K1: write the index as a new store version, then read it back."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    store.save(base_index(spark, sf_dir))
    return store.load().select("file", "chunk_index", "mtime", F.size("embedding").alias("dim"))


@register("load_index")
def q_load_index(spark, sf_dir):
    """A whole version and a delta; load returns the newest state only."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    store.save(base_index(spark, sf_dir))
    store.save_delta(*index_delta(store.load(), V.files_head(spark, sf_dir)))
    return store.load().select("file", "chunk_index", "mtime")


# ------------------------------------------------------- responses (5) -----


@register("parse_response_lines")
def q_parse_response_lines(spark, sf_dir):
    return RS.parse_response_lines(V.response_lines(spark, sf_dir)).select("response_id", "line_no", "token")


@register("split_reasoning")
def q_split_reasoning(spark, sf_dir):
    return RS.split_reasoning(V.tokens(spark, sf_dir))


@register("strip_fence")
def q_strip_fence(spark, sf_dir):
    a = V.fenced_answers(spark, sf_dir)
    return a.select("response_id", RS.strip_fence(F.col("final")).alias("content"))


@register("verdict")
def q_verdict(spark, sf_dir):
    return RS.verdict(V.audit_answers(spark, sf_dir)).select("response_id", "status", "exit_code")


@register("findings")
def q_findings(spark, sf_dir):
    return RS.findings(V.audit_answers(spark, sf_dir))


@register("final_text")
def q_final_text(spark, sf_dir):
    return RS.final_text(V.audit_answers(spark, sf_dir)).select("response_id", "answer", "failed")


@register("visible_output")
def q_visible_output(spark, sf_dir):
    return RS.visible_output(RS.split_reasoning(V.tokens(spark, sf_dir))).select("response_id", "shown")


# ------------------------------------------- context, prompts, jobs (4) -----


def base_hits(spark, sf_dir):
    return retrieve(base_index(spark, sf_dir), benchmark_questions(spark, sf_dir), K.TOP_K)


@register("hit_metadata")
def q_hit_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = knn(e, label_exemplars(spark, sf_dir), K.TOP_K, keys=["vec_id"])
    return hits.join(e.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "rank", "label")


@register("rank_hits")
def q_rank_hits(spark, sf_dir):
    return base_hits(spark, sf_dir).select("query_id", "file", "chunk_index", "rank")


@register("format_score")
def q_format_score(spark, sf_dir):
    return base_hits(spark, sf_dir).select("query_id", "rank", "score")


@register("context_block")
def q_context_block(spark, sf_dir):
    return CX.context_block(base_hits(spark, sf_dir))


@register("retrieval_query")
def q_retrieval_query(spark, sf_dir):
    return CX.retrieval_queries(V.files_base(spark, sf_dir))


def probe_hits(spark, sf_dir):
    return retrieve(base_index(spark, sf_dir), CX.probe_queries(spark), K.TOP_K)


@register("probe_queries")
def q_probe_queries(spark, sf_dir):
    return probe_hits(spark, sf_dir).select("query_id", "rank", "file", "chunk_index", "score")


@register("dedup_hits")
def q_dedup_hits(spark, sf_dir):
    return CX.dedup_hits(probe_hits(spark, sf_dir)).select("query_id", "rank", "file", "chunk_index")


def mapped_corpus(spark, sf_dir, view=V.files_base):
    """S3 over a snapshot with the inline ignore patterns, plus the path
    relative to its root."""
    return JB.mapped_files(view(spark, sf_dir), SC.ignore_patterns(spark, ignore_lines_df(spark)))


def map_summaries(spark, sf_dir):
    return JB.map_summaries(mapped_corpus(spark, sf_dir), V.scripted())


@register("prompt_summary")
def q_prompt_summary(spark, sf_dir):
    return JB.map_prompts(mapped_corpus(spark, sf_dir)).select("source", "rel_path", "window", "system", "user")


@register("generate_batch")
def q_generate_batch(spark, sf_dir):
    return map_summaries(spark, sf_dir)


@register("file_tree")
def q_file_tree(spark, sf_dir):
    return CX.file_tree(mapped_corpus(spark, sf_dir))


@register("summaries_concat")
def q_summaries_concat(spark, sf_dir):
    return CX.summaries_concat(map_summaries(spark, sf_dir))


def budgeted(spark, sf_dir):
    return CX.budget_prompt(mapped_corpus(spark, sf_dir), map_summaries(spark, sf_dir))


@register("budget_prompt")
def q_budget_prompt(spark, sf_dir):
    return budgeted(spark, sf_dir)


@register("prompt_architect")
def q_prompt_architect(spark, sf_dir):
    return JB.architect_prompts(budgeted(spark, sf_dir)).select("source", "window", "system", "user")


@register("analyze_map_reduce")
def q_analyze_map_reduce(spark, sf_dir):
    return JB.reports(JB.architect_prompts(budgeted(spark, sf_dir)), V.scripted())


@register("analyze_sampled")
def q_analyze_sampled(spark, sf_dir):
    """One report per indexed root, from the probes' hits in its files."""
    return JB.reports(JB.sampled_prompts(base_index(spark, sf_dir)), V.scripted())


@register("analyze")
def q_analyze(spark, sf_dir):
    """The later snapshot against the index of the earlier one. Roots
    that are indexed get the sampled report, the others the full one."""
    return JB.analyze(mapped_corpus(spark, sf_dir, V.files_head), base_index(spark, sf_dir), V.scripted())


def ask_prompts(spark, sf_dir):
    ctx = CX.context_block(base_hits(spark, sf_dir))
    q = benchmark_questions(spark, sf_dir).withColumnRenamed("text", "question")
    j = q.join(ctx.select("query_id", F.col("scored_context").alias("context")), "query_id")
    return j.select("query_id", F.lit(PR.ROUTE["ask"]).alias("purpose"),
                    PR.system("ask").alias("system"), PR.user("ask").alias("user"))


@register("prompt_ask")
def q_prompt_ask(spark, sf_dir):
    return ask_prompts(spark, sf_dir).select("query_id", "system", "user")


@register("ask")
def q_ask(spark, sf_dir):
    """C4: C3 -> A4 (scored) -> P8 -> M1 as token pieces -> W3 -> T15."""
    asked = ask_prompts(spark, sf_dir)
    split = RS.split_reasoning(generate_tokens(asked, "query_id", V.scripted()))
    whole = asked.select(F.col("query_id").alias("response_id")).join(split, "response_id", "left")  # an empty answer has no pieces
    return RS.final_text(whole.na.fill("", ["thinking", "final"])).select(F.col("response_id").alias("query_id"), "answer", "failed")


@register("generate_stream")
def q_generate_stream(spark, sf_dir):
    """M1 as a stream: the prompts of C4 wait in a queue, a generator's pieces
    come from the token source and go through X1."""
    queue, out, ck = PromptQueue(spark, scratch_path(spark, "queue")), scratch_path(spark, "gen-out"), scratch_path(spark, "gen-ck")
    queue.add(ask_prompts(spark, sf_dir).withColumnRenamed("query_id", "response_id"))
    XR.run_available(XR.split_reasoning_stream(token_stream(queue, V.scripted_model), idle_ms=None), out, ck)
    return spark.read.schema(XR.OUT_SCHEMA).parquet(out)


@register("snapshot_changes")
def q_snapshot_changes(spark, sf_dir):
    return CH.snapshot_changes(V.files_base(spark, sf_dir), V.files_head(spark, sf_dir))


@register("modified_files")
def q_modified_files(spark, sf_dir):
    return CH.modified_files(V.files_base(spark, sf_dir), V.files_head(spark, sf_dir))


@register("changed_lines")
def q_changed_lines(spark, sf_dir):
    return CH.changed_lines(V.files_base(spark, sf_dir), V.files_head(spark, sf_dir))


# --------------------------------------------------------- patches (6) -----


def parsed_patches(spark, sf_dir):
    return PT.parse_patches(V.patch_responses(spark, sf_dir))


def patch_run(spark, sf_dir):
    return PT.apply_patches(parsed_patches(spark, sf_dir), V.patch_files(spark, sf_dir))


@register("parse_patches")
def q_parse_patches(spark, sf_dir):
    return parsed_patches(spark, sf_dir)


@register("preview_patch")
def q_preview_patch(spark, sf_dir):
    return PT.preview_patch(parsed_patches(spark, sf_dir))


@register("patch_targets")
def q_patch_targets(spark, sf_dir):
    t = PT.patch_targets(parsed_patches(spark, sf_dir), V.patch_files(spark, sf_dir))
    return t.select("response_id", "patch_no", "file", "found", "error")


@register("apply_patches")
def q_apply_patches(spark, sf_dir):
    applied = patch_run(spark, sf_dir)
    return PT.patch_results(applied)


@register("patch_summary")
def q_patch_summary(spark, sf_dir):
    applied = patch_run(spark, sf_dir)
    return PT.patch_summary(PT.patch_results(applied))


@register("write_patched")
def q_write_patched(spark, sf_dir):
    """K4: the whole snapshot after the answers of two rounds, one row per
    file, written as a new table and read back."""
    answers = V.patch_responses(spark, sf_dir).unionByName(V.second_answers(spark, sf_dir))
    snapshot, _ = PT.patch_snapshot(PT.parse_patches(answers), V.patch_files(spark, sf_dir))
    return write_snapshot(snapshot, "patched")


@register("patch_conflicts")
def q_patch_conflicts(spark, sf_dir):
    """C12 over two answers to each file: every patch's result, and whether an
    earlier patch had changed the text that it searches."""
    answers = V.patch_responses(spark, sf_dir).unionByName(V.second_answers(spark, sf_dir))
    return PT.patch_snapshot(PT.parse_patches(answers), V.patch_files(spark, sf_dir))[1]


# ------------------------------------------------------------ jobs (7) -----


def base_changes(spark, sf_dir):
    return JB.change_sets(V.files_base(spark, sf_dir), V.files_head(spark, sf_dir))


@register("prompt_commit")
def q_prompt_commit(spark, sf_dir):
    return JB.commit_prompts(base_changes(spark, sf_dir)).select("source", "window", "system", "user")


@register("commit_messages")
def q_commit_messages(spark, sf_dir):
    return JB.commit_messages(base_changes(spark, sf_dir), V.scripted())


@register("prompt_review")
def q_prompt_review(spark, sf_dir):
    return JB.review_prompts(base_changes(spark, sf_dir), base_index(spark, sf_dir), V.wants_fix()).select(
        "source", "window", "fix", "system", "user")


@register("review")
def q_review(spark, sf_dir):
    return JB.review(base_changes(spark, sf_dir), base_index(spark, sf_dir), V.scripted(), V.wants_fix())


def audit_inputs(spark, sf_dir):
    return JB.audit_payloads(SC.scan_code_files(V.files_base(spark, sf_dir)))


@register("prompt_audit")
def q_prompt_audit(spark, sf_dir):
    return JB.audit_prompts(audit_inputs(spark, sf_dir), base_index(spark, sf_dir), V.wants_fix()).select(
        "source", "window", "fix", "system", "user")


@register("audit")
def q_audit(spark, sf_dir):
    return JB.audit(audit_inputs(spark, sf_dir), base_index(spark, sf_dir), V.scripted(), V.wants_fix())


def doc_results(spark, sf_dir):
    fb = V.files_base(spark, sf_dir)
    return JB.generate_docs(SC.scan_code_files(fb), fb, V.existing_docs(spark, sf_dir), V.scripted())


@register("docs_existing")
def q_docs_existing(spark, sf_dir):
    jobs = CO.doc_jobs(root_targets(spark, sf_dir))
    return JB.docs_existing(jobs, V.existing_docs(spark, sf_dir)).select("source", "doc_type", "dest_path", "is_update")


@register("prompt_doc")
def q_prompt_doc(spark, sf_dir):
    fb = V.files_base(spark, sf_dir)
    return JB.doc_prompts(SC.scan_code_files(fb), fb, V.existing_docs(spark, sf_dir)).select(
        "source", "doc_type", "window", "system", "user")


@register("generate_docs")
def q_generate_docs(spark, sf_dir):
    return doc_results(spark, sf_dir).select("source", "doc_type", "dest_path", "status", "doc")


@register("write_generated")
def q_write_generated(spark, sf_dir):
    return JB.write_generated(doc_results(spark, sf_dir))


@register("job_summary")
def q_job_summary(spark, sf_dir):
    return JB.job_summary(doc_results(spark, sf_dir))


def test_targets(spark, sf_dir):
    return CH.modified_files(V.files_base(spark, sf_dir), V.files_head(spark, sf_dir))


@register("tests_existing")
def q_tests_existing(spark, sf_dir):
    t = JB.tests_existing(test_targets(spark, sf_dir), V.files_head(spark, sf_dir))
    return t.select("path", "test_path", "language", "framework", "is_update")


@register("prompt_test")
def q_prompt_test(spark, sf_dir):
    return JB.test_prompts(test_targets(spark, sf_dir), V.files_head(spark, sf_dir), base_index(spark, sf_dir)).select(
        "path", "test_path", "system", "user")


@register("generate_tests")
def q_generate_tests(spark, sf_dir):
    return JB.generate_tests(test_targets(spark, sf_dir), V.files_head(spark, sf_dir), V.scripted(), base_index(spark, sf_dir))


@register("write_tests")
def q_write_tests(spark, sf_dir):
    return JB.write_tests(q_generate_tests(spark, sf_dir))


@register("write_report")
def q_write_report(spark, sf_dir):
    return JB.write_report(q_analyze_map_reduce(spark, sf_dir))


PURPOSES = ["default", "fast", "coding", "review", "embedding", "summary"]


@register("route_model")
def q_route_model(spark, sf_dir):
    """Every document's request routed by purpose (cycled over six,
    one of them not configured)."""
    d = table(spark, sf_dir, "documents")
    req = d.select("doc_id", F.element_at(F.array(*[F.lit(p) for p in PURPOSES]),
                                          (d.doc_id % len(PURPOSES) + 1).cast("int")).alias("purpose"))
    return RT.route_model(req, RT.routes(spark)).select("doc_id", "purpose", "model", "num_ctx", "num_predict")


# ------------------------------------------------------- streaming (X) -----

# Tokens 10 to 29 arrive before the first ten.
ARRIVALS = [(10, 30), (0, 10), (30, None)]


def _feed(df, input_dir, fmt="parquet"):
    """Test harness: write token arrivals as separate file batches."""
    for lo, hi in ARRIVALS:
        part = df.where(F.col("seq") >= lo)
        if hi is not None:
            part = part.where(F.col("seq") < hi)
        part = part.repartition(4, "response_id")
        (part.write.mode("append").parquet(input_dir) if fmt == "parquet"
         else part.select("value").write.mode("append").text(input_dir))


@register("split_reasoning_stream")
def q_split_reasoning_stream(spark, sf_dir):
    """Tokens arrive in three batches; state carries across micro-batches."""
    inp, out, ck = (scratch_path(spark, n) for n in ("tok-in", "tok-out", "tok-ck"))
    _feed(V.tokens(spark, sf_dir), inp)
    stream = spark.readStream.schema(XR.TOKEN_SCHEMA).option("maxFilesPerTrigger", 4).parquet(inp)
    XR.run_available(XR.split_reasoning_stream(stream, idle_ms=None), out, ck)
    return spark.read.parquet(out).unionByName(XR.waiting_tokens(spark, ck))


@register("response_stream")
def q_response_stream(spark, sf_dir):
    """Raw model lines arrive as text files; tokens come out."""
    inp, out, ck = (scratch_path(spark, n) for n in ("lines-in", "lines-out", "lines-ck"))
    lines = V.response_lines(spark, sf_dir).withColumn("seq", F.col("line_no") / 2) \
        .withColumn("value", F.concat_ws("\t", F.col("response_id").cast("string"),
                                         F.col("line_no").cast("string"), F.col("line")))
    _feed(lines, inp, fmt="text")
    XR.run_available(XR.response_stream(spark, inp), out, ck)
    return spark.read.parquet(out)


@register("update_index_stream")
def q_update_index_stream(spark, sf_dir):
    """The changes to the head snapshot arrive in several batches and
    update the stored index by deltas."""
    store = IndexStore(spark, scratch_path(spark, "stream-index"))
    store.save(base_index(spark, sf_dir))
    inp, ck = scratch_path(spark, "snap-in"), scratch_path(spark, "snap-ck")
    head = V.files_head(spark, sf_dir)
    puts = head.select("path", "mtime", "content", F.lit("put").alias("op"))
    gone = V.files_base(spark, sf_dir).join(head, "path", "left_anti") \
        .select("path", F.lit(None).cast("double").alias("mtime"), F.lit(None).cast("string").alias("content"), F.lit("delete").alias("op"))
    puts.unionByName(gone).repartition(3, "path").write.parquet(inp)
    XU.update_from_stream(spark, store, inp, ck, files_per_batch=1)
    return store.load().select("file", "chunk_index", "mtime")


@register("doc_path")
def q_doc_path(spark, sf_dir):
    """Output path ``docs/<type>/<stem>.md`` of each documentation job."""
    return CO.doc_jobs(root_targets(spark, sf_dir)).select("source", "doc_type", "dest_path")
