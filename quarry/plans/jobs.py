"""Model jobs over change sets and corpora (C5-C8, C11) and their steps
(P1-P5, J6, J7, A9, K2, K3, K5).

Every job is a DataFrame pipeline: one row per change set / document job /
test target, prompts as columns, the model step as ``generate_batch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import paths as P
from quarry.functions import prompts as PR
from quarry.functions import text as TX
from quarry.operators import changes as CH
from quarry.operators import context as CX
from quarry.operators import corpus as CO
from quarry.operators import index_ops as IX
from quarry.operators import patches as PT
from quarry.operators import responses as RS
from quarry.operators import scan as SC
from quarry.operators.generate import final_answers, generate_batch, merge_answers
from quarry.operators.ordering import ordered_windows
from quarry.plans.indexing import retrieve, root_of
from quarry.sinks.tables import write_snapshot


def change_sets(base: DataFrame, head: DataFrame, root_col: str = "source", limit: int = K.MAX_PAYLOAD_CHARS) -> DataFrame:
    """Per root: the diff of all changed files in path order, whole, as
    windows of ``limit`` characters. Roots without changes have no row."""
    roots = head.select("path", root_col).unionByName(base.select("path", root_col)).dropDuplicates(["path"])
    pf = CH.change_payload(base, head).join(roots, "path")
    rows = ordered_windows(pf, [root_col], P.parts(F.col("path")), F.col("diff"), "\n", limit)
    return rows.select(root_col, "window", "n_windows", F.col("n_rows").alias("n_files"), F.col("text").alias("diff"))


def _prompt(df: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.lit(PR.ROUTE[kind]).alias("purpose"), PR.system(kind).alias("system"),
                     PR.user(kind).alias("user"))


def _split(ans: DataFrame) -> DataFrame:
    """W3 on whole answers: ``thinking`` and ``final`` beside them."""
    thinking, final = RS.whole_answer(F.coalesce("response", F.lit("")))
    return ans.withColumn("thinking", thinking).withColumn("final", final)


WINDOW = ["source", "window", "n_windows"]


def commit_prompts(changes: DataFrame) -> DataFrame:
    """P1, one prompt per window of the diff."""
    return _prompt(changes, "commit", WINDOW)


def commit_messages(changes: DataFrame, generator=None) -> DataFrame:
    """C11: one proposed message per change set."""
    ans = merge_answers(generate_batch(commit_prompts(changes), generator), ["source"], "commit", generator)
    return ans.select("source", TX.py_strip(F.coalesce("response", F.lit(""))).alias("message"))


def with_context(df: DataFrame, index: DataFrame | None, query: F.Column, keys: list[str], k: int = K.TOP_K,
                 root: F.Column | None = None, embed=None) -> DataFrame:
    """Optional retrieval: ``context`` = A4 block of the top-k chunks for
    ``query`` (NULL without an index or hits). One query per row of ``df``,
    which ``keys`` identify; it is answered from the files of the row's
    ``root`` (default: ``source``) only. ``embed`` is the embedder of the index
    (default: the hashed one)."""
    if index is None:
        return df.withColumn("context", F.lit(None).cast("string"))
    keyed = df.withColumn("query_id", F.to_json(F.array(*[F.col(c).cast("string") for c in keys])))
    keyed = write_snapshot(keyed, "asked")  # read for the questions and again for the prompts
    asked = keyed.select("query_id", query.alias("text"), (F.col("source") if root is None else root).alias("root"))
    ctx = CX.context_block(retrieve(index, asked, k, embed=embed, index_root=root_of(F.col("file")))).select("query_id", "context")
    return keyed.join(ctx, "query_id", "left").drop("query_id")


def _with_fix(df: DataFrame, fix) -> DataFrame:
    return df.withColumn("fix", F.lit(fix) if isinstance(fix, bool) else fix)


def review_prompts(changes: DataFrame, index: DataFrame | None = None, fix=False, embed=None) -> DataFrame:
    """P2 per window of a change set; ``fix`` (a flag or a column) asks for
    edit blocks."""
    q = F.concat(F.lit(K.REVIEW_QUERY_PREFIX), F.substring("diff", 1, K.QUERY_PREFIX_CHARS))
    return _prompt(_with_fix(with_context(changes, index, q, WINDOW[:2], embed=embed), fix), "review", [*WINDOW, "fix"])


def review(changes: DataFrame, index: DataFrame | None = None, generator=None, fix=False, embed=None) -> DataFrame:
    """Review text per change set, failure flag, and the edit blocks found
    in all of its windows."""
    ans = _split(generate_batch(review_prompts(changes, index, fix, embed), generator))
    split = write_snapshot(ans.select(*WINDOW, F.col("final").alias("response"), "thinking", "error"), "answers")
    blocks = PT.parse_patches(split.select(F.col("source").alias("response_id"), F.col("response").alias("text")))
    n_p = blocks.groupBy(F.col("response_id").alias("source")).agg(F.count(F.lit(1)).alias("n_patches"))
    empty = (F.length(F.coalesce("response", F.lit(""))) == 0) & (F.length(F.coalesce("thinking", F.lit(""))) == 0)
    failed = split.groupBy("source").agg(F.bool_or(empty | F.col("error").isNotNull()).alias("failed"))
    text = merge_answers(split, ["source"], "review", generator).select("source", "response")
    return text.join(failed, "source").join(n_p, "source", "left").select(
        "source", TX.py_strip(F.coalesce("response", F.lit(""))).alias("review"), "failed",
        F.coalesce("n_patches", F.lit(0)).alias("n_patches"))


def audit_payloads(code_files: DataFrame) -> DataFrame:
    """Audit input per root: the whole code corpus without suppressed lines
    (F5), in windows."""
    return CO.concat_corpus(SC.suppress_lines(code_files)).select(*WINDOW, F.col("payload").alias("code"))


def audit_prompts(payloads: DataFrame, index: DataFrame | None = None, fix=False, embed=None) -> DataFrame:
    """P3 per window: the audit query is its first 500 characters, newlines as spaces."""
    q = F.concat(F.lit(K.AUDIT_QUERY_PREFIX),
                 TX.py_strip(F.replace(F.substring("code", 1, K.QUERY_PREFIX_CHARS), F.lit("\n"), F.lit(" "))))
    return _prompt(_with_fix(with_context(payloads, index, q, WINDOW[:2], embed=embed), fix), "audit", [*WINDOW, "fix"])


def audit(payloads: DataFrame, index: DataFrame | None = None, generator=None, fix=False, embed=None) -> DataFrame:
    """Verdict (T12) and finding count (T13) per root: findings if any
    window has some, else error if any window gave no answer, else clear."""
    ans = RS.verdict(_split(generate_batch(audit_prompts(payloads, index, fix, embed), generator)))
    split = write_snapshot(ans.select(F.struct("source", "window").alias("response_id"), "status", "final"), "answers")
    nf = RS.findings(split).groupBy(F.col("response_id.source").alias("source")).agg(F.count(F.lit(1)).alias("n_findings"))
    worst = F.max(F.when(F.col("status") == "findings", 2).when(F.col("status") == "error", 1).otherwise(0))
    v = split.groupBy(F.col("response_id.source").alias("source")).agg(worst.alias("worst"))
    return v.join(nf, "source", "left").select(
        "source", F.element_at(F.array(*[F.lit(x) for x in ("clear", "error", "findings")]), F.col("worst") + 1).alias("status"),
        F.when(F.col("worst") == 0, 0).otherwise(1).alias("exit_code"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def docs_existing(jobs: DataFrame, existing_docs: DataFrame) -> DataFrame:
    """Job joined to an existing document at its output path."""
    e = existing_docs.select(F.col("path").alias("dest_path"), F.col("content").alias("existing"))
    return jobs.join(e, "dest_path", "left").withColumn("is_update", F.col("existing").isNotNull())


DOC_JOB = ["source", "doc_type", "label", "dest_path", "is_update"]


def doc_prompts(code_files: DataFrame, all_files: DataFrame, existing_docs: DataFrame,
                hint: str | None = None) -> DataFrame:
    """A3 -> A2 -> G3 -> J7 -> P4: four jobs per root, one prompt per window of
    the code corpus; the language counts every file of the root."""
    payload = CO.concat_corpus(code_files).select(*WINDOW, F.col("payload").alias("code"))
    lang = CO.dominant_language(all_files).select("source", "language")
    targets = payload.join(lang, "source").withColumn("stem", F.col("source"))
    jobs = docs_existing(CO.doc_jobs(targets), existing_docs).withColumn("hint", F.lit(hint).cast("string"))
    return _prompt(jobs, "doc", [*DOC_JOB, "window", "n_windows"])


def generate_docs(code_files: DataFrame, all_files: DataFrame, existing_docs: DataFrame,
                  generator=None, hint: str | None = None) -> DataFrame:
    """Status per job - error, empty, updated or created - and the document
    (the final part of the answer, W3)."""
    ans = generate_batch(doc_prompts(code_files, all_files, existing_docs, hint), generator)
    out = merge_answers(final_answers(ans), DOC_JOB, "doc", generator)
    res = out.withColumn("doc", TX.py_strip(F.coalesce("response", F.lit("")))).withColumn(
        "status", F.when(F.col("error").isNotNull(), F.lit("error")).when(F.length("doc") == 0, F.lit("empty"))
        .when(F.col("is_update"), F.lit("updated")).otherwise(F.lit("created")))
    return res.select("source", "doc_type", "label", "dest_path", "status", "doc")


def write_generated(results: DataFrame, path: str | None = None) -> DataFrame:
    """K2: write the created and updated documents as a new table partitioned
    by type, at ``path`` (which must not exist; default: a scratch folder)."""
    docs = results.where(F.col("status").isin("created", "updated")).select("doc_type", "dest_path", "doc")
    return write_snapshot(docs, "docs", partition_by=["doc_type"], path=path)


def job_summary(results: DataFrame) -> DataFrame:
    """Jobs counted by type and status."""
    return results.groupBy("label", "status").agg(F.count(F.lit(1)).alias("n_jobs"))


def tests_existing(targets: DataFrame, head: DataFrame) -> DataFrame:
    """Source file joined to an existing test at its derived path."""
    e = head.select(F.col("path").alias("test_path"), F.col("content").alias("existing"))
    return CO.test_targets(targets).join(e, "test_path", "left").withColumn("is_update", F.col("existing").isNotNull())


def test_prompts(modified: DataFrame, head: DataFrame, index: DataFrame | None = None, embed=None) -> DataFrame:
    """S8 -> T6, T7 -> J6 -> C3 (with an index: definitions used by the file) -> P5."""
    t = tests_existing(modified, head)
    code = head.select("path", F.col("content").alias("code"))
    j = t.join(code, "path").withColumn("mode", F.when(F.col("is_update"), F.lit("update")).otherwise(F.lit("new")))
    j = with_context(j, index, F.concat(F.lit(K.TESTS_QUERY_PREFIX), P.name(F.col("path"))), ["path"], root=root_of(F.col("path")), embed=embed)
    return _prompt(j, "test", ["path", "test_path", "is_update"])


def generate_tests(modified: DataFrame, head: DataFrame, generator=None, index: DataFrame | None = None, embed=None) -> DataFrame:
    """C7 + K3 plan: generated test text (the final part of the answer, W3,
    after fence strip, T10) and the action - error, skip (no text), update of an
    existing test, or create."""
    out = _split(generate_batch(test_prompts(modified, head, index, embed), generator))
    return out.select(
        "path", F.col("test_path").alias("dest_path"), RS.strip_fence(F.col("final")).alias("content"),
        F.when(F.col("error").isNotNull(), F.lit("error")).when(F.length("final") == 0, F.lit("skip"))
        .when(F.col("is_update"), F.lit("update")).otherwise(F.lit("create")).alias("action"))


def write_tests(plan: DataFrame, path: str | None = None) -> DataFrame:
    """K3: write the planned test files (those to create or update) as a new table."""
    return write_snapshot(plan.where(F.col("action").isin("create", "update")).select("dest_path", "content", "action"), "tests", path=path)


def architect_prompts(budgeted: DataFrame) -> DataFrame:
    """P7, one prompt per window of T4."""
    return _prompt(budgeted, "architect", WINDOW)


def reports(prompts: DataFrame, generator=None) -> DataFrame:
    """C9/C10's last step: one report per root (the final part of the merged
    answer, W3); an empty report or a failed call is an error."""
    ans = merge_answers(final_answers(generate_batch(prompts, generator)), ["source"], "architect", generator)
    text = TX.py_strip(F.coalesce("response", F.lit("")))
    return ans.select("source", text.alias("report"),
                      F.when((F.length(text) == 0) | F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("ok")).alias("status"))


def mapped_files(files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """S3 plus the path relative to the root."""
    return SC.scan_mapped_files(files, patterns).withColumn("rel_path", F.expr("substring(path, length(source) + 2)"))


def map_prompts(files: DataFrame) -> DataFrame:
    """C9 map stage input: F3 -> P6, one prompt per window of 30,000
    characters of a file."""
    nb = SC.drop_blank(files, "content")
    n = F.ceil(F.length("content") / K.MAX_FILE_CHARS)
    t = nb.withColumn("n_windows", n).withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    t = t.withColumn("content", F.substr("content", (F.col("window") * K.MAX_FILE_CHARS + 1).cast("int"), F.lit(K.MAX_FILE_CHARS)))
    return _prompt(t, "summary", ["source", "rel_path", "window", "n_windows"])


def map_summaries(files: DataFrame, generator=None) -> DataFrame:
    """C9's map step: one summary per file that has text."""
    ans = final_answers(generate_batch(map_prompts(files), generator))
    return merge_answers(ans, ["source", "rel_path"], "summary", generator).select("source", "rel_path", F.col("response").alias("summary"))


def full_prompts(files: DataFrame, generator=None) -> DataFrame:
    """C9 -> T4 -> P7: the tree and the summaries of every file of a root."""
    summaries = write_snapshot(map_summaries(files, generator), "summaries")
    return architect_prompts(CX.budget_prompt(files.select("source", "rel_path"), summaries))


def sampled_prompts(index: DataFrame, k: int = K.TOP_K, embed=None) -> DataFrame:
    """C10 -> T4 -> P7: per root of the index, the hits of the probes (G4) in its
    own files, without those that repeat (W2), in place of the summaries, and its
    indexed files as the tree."""
    root = root_of(F.col("file"))
    within = F.expr("substring(file, length(source) + 2)")
    files = IX.distinct_files(index).select(root.alias("source"), "file").withColumn("rel_path", within)
    asked = files.select("source").distinct().select("source", F.posexplode(F.array(*map(F.lit, K.PROBES))).alias("probe", "text"))
    asked = asked.select(F.format_string("%04d/%s", "probe", "source").alias("query_id"), "text", F.col("source").alias("root"))
    hits = retrieve(index, asked, k, embed=embed, index_root=root).withColumn("source", root).withColumn("query_id", F.substring("query_id", 1, 4).cast("int"))
    hits = CX.dedup_hits(hits, ["source"])
    summaries = hits.select("source", F.format_string("%04d/%04d", "query_id", "rank").alias("rel_path"), "file", F.col("text").alias("summary")) \
        .withColumn("file", within)
    return architect_prompts(CX.budget_prompt(files.select("source", "rel_path"), summaries, label_col="file"))


def analyze(files: DataFrame, index: DataFrame, generator=None, embed=None) -> DataFrame:
    """C9/C10 by root, in one job: roots of ``files`` (``mapped_files``) that
    have rows in the index get the sampled plan, the others the full one. Of the
    index only file names are read to tell them apart."""
    indexed = IX.distinct_files(index).select(root_of(F.col("file")).alias("source")).distinct()
    asked = files.select("source").distinct()
    known = index.join(asked.withColumnRenamed("source", "_root"), root_of(F.col("file")) == F.col("_root"), "left_semi")
    full = full_prompts(files.join(indexed, "source", "left_anti"), generator)
    return reports(full.unionByName(sampled_prompts(known, embed=embed)), generator)


def write_report(reports: DataFrame, path: str | None = None) -> DataFrame:
    """K5: write one report per root; failed and empty reports are not written."""
    return write_snapshot(reports.where(F.col("status") == "ok").select("source", "report"), "reports", path=path)
