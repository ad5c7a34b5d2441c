"""DuckDB oracle SQL, one statement per registered query key.

Tables are the driver's pre-registered views; derived views come from
``sqlparts`` as CTEs so both engines read identical inputs.
"""

from __future__ import annotations

from quarry import constants as K
from quarry.checks import sqlparts as S
from quarry.functions import prompts as PR
from quarry.functions.text import RSTRIP_RE as TX_RSTRIP
from quarry.operators import context as CX
from quarry.operators import patches as PTC
from quarry.operators import responses as RS
from quarry.plans.catalog import PURPOSES

ORACLE: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE["scan_index_files"] = _with(S.FILES_BASE) + f"""
SELECT path, mtime, source FROM files_base WHERE {S.index_scan_where()}"""

ORACLE["chunk_text"] = S.chunks_of("documents", "doc_id", "text")

_INDEX_CHUNKS = f"idx AS ({S.index_chunks()})"

ORACLE["embed_chunks"] = _with(S.FILES_BASE, _INDEX_CHUNKS) + f"""
SELECT file, CAST(bucket AS INTEGER) AS bucket, chunk_index, CAST(cnt / norm AS FLOAT) AS weight
FROM {S.sparse_embedding('idx', 'file, chunk_index')}"""

_EXEMPLARS = """q AS (SELECT min(vec_id) AS query_id, arg_min(embedding, vec_id) AS qe
          FROM embeddings GROUP BY label)"""

ORACLE["knn"] = _with(_EXEMPLARS) + f"""
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, distance FROM (
  SELECT query_id, vec_id, distance,
         row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
  FROM (SELECT q.query_id, e.vec_id, {S.sql_distance('q.qe', 'e.embedding')} AS distance
        FROM q, embeddings e))
WHERE rank <= {K.TOP_K}"""

ORACLE["top_k"] = f"""
WITH q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, distance, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank
FROM (SELECT e.vec_id, {S.sql_distance('q.qe', 'e.embedding')} AS distance FROM q, embeddings e)
ORDER BY distance, vec_id LIMIT {K.TOP_K}"""


def _hits_sql(k: int = K.TOP_K) -> str:
    """C3 over files_base with benchmark questions: CTEs idx, ivec, qvec, hits."""
    return f""",
ivec AS {S.dense_embedding('idx', 'file, chunk_index')},
qsrc AS (SELECT item_id AS query_id, text FROM benchmark),
qvec AS {S.dense_embedding('qsrc', 'query_id')},
hits AS (
  SELECT * FROM (
    SELECT query_id, file, chunk_index, distance,
           row_number() OVER (PARTITION BY query_id ORDER BY distance, file, chunk_index) AS rank
    FROM (SELECT q.query_id, i.file, i.chunk_index, {S.sql_distance('q.embedding', 'i.embedding')} AS distance
          FROM qvec q, ivec i))
  WHERE rank <= {k})
"""


ORACLE["retrieve"] = _with(S.FILES_BASE, _INDEX_CHUNKS) + _hits_sql() + """
SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.file, h.chunk_index, i.text, h.distance,
       printf('%.4f', h.distance) AS score
FROM hits h JOIN idx i USING (file, chunk_index)"""


# ------------------------------------------------- scan family (batch 2) -----


# The ignore lines above that are patterns, stated again for DuckDB's own GLOB;
# a bracket that is never closed is plain text there ("[[]").
_GLOBS = ["*.kt", "src1*", "*/f1?.ts", "docs/", "*/docs/f2*", "*/f[0-3][!0-7].js", "[[]x.py", "src0/*/f*[]5].md"]
_PAT_CTE = "pats AS (SELECT unnest(" + S.str_list(_GLOBS) + ") AS pat)"
_NOT_IGNORED = f"NOT EXISTS (SELECT 1 FROM pats WHERE f.path GLOB pat OR {S.name('f.path')} GLOB pat OR (f.path || '/') GLOB pat)"
_LANG = "lm(ext, language, framework, prefix, suffix) AS (VALUES " + ", ".join(
    "(" + ", ".join(S.lit(v) for v in row) + ")" for row in K.LANGUAGE_MAP) + ")"

ORACLE["scan_code_files"] = _with(S.FILES_BASE) + f"""
SELECT path, mtime, source FROM files_base WHERE {S.code_scan_where()}"""

ORACLE["scan_mapped_files"] = _with(S.FILES_BASE, _PAT_CTE, _LANG) + f"""
SELECT path, source FROM files_base f
WHERE NOT {S.has_part_in('path', K.CODE_IGNORE_DIRS)}
  AND lower({S.suffix('path')}) IN (SELECT ext FROM lm) AND {_NOT_IGNORED}"""

ORACLE["read_text"] = _with(S.FILES_BASE) + """
SELECT path, content FROM files_base"""

ORACLE["ignored_dirs"] = _with(S.FILES_BASE) + f"""
SELECT path, {S.has_part_in('path', K.INDEX_IGNORE_DIRS)} AS ignored FROM files_base"""

ORACLE["ignore_patterns"] = _with(S.FILES_BASE, _PAT_CTE) + f"""
SELECT path FROM files_base f WHERE {_NOT_IGNORED}"""

ORACLE["drop_blank"] = f"""
SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND NOT ({S.is_blank('text')})"""

ORACLE["oversized"] = f"SELECT doc_id, length(text) > {K.MAX_PAYLOAD_CHARS} AS oversized FROM documents"

# The documents hold no marker; of the five last lines that the view adds,
# the first, second and fifth are comments that suppress.
ORACLE["suppress_lines"] = """
SELECT doc_id, CAST(length(kept) AS INTEGER) AS n_chars, md5(kept) AS text_md5 FROM (
  SELECT doc_id, text || CASE doc_id % 5 WHEN 2 THEN chr(10) || '// ignore-sec here' WHEN 3 THEN chr(10) || 'z  #ignore-secs' ELSE '' END AS kept
  FROM documents)"""

ORACLE["path_facts"] = _with(S.FILES_BASE) + f"""
SELECT path, {S.name('path')} AS name, {S.stem('path')} AS stem, lower({S.suffix('path')}) AS suffix,
       substring(path, length(source) + 2) AS rel_path FROM files_base"""

ORACLE["sort_paths"] = _with(S.FILES_BASE) + """
SELECT source, path,
  row_number() OVER (PARTITION BY source ORDER BY string_split(path, '/'), path) AS part_rank,
  row_number() OVER (PARTITION BY source ORDER BY path) AS string_rank
FROM files_base"""

ORACLE["language_of"] = _with(S.FILES_BASE, _LANG) + f"""
SELECT path, coalesce(language, 'Generic') AS language, coalesce(framework, 'generic') AS framework,
       prefix AS test_prefix, suffix AS test_suffix
FROM files_base f LEFT JOIN lm ON lower({S.suffix('f.path')}) = lm.ext"""

_MOVED = "replace(f.path, 'src/', 'tests/')"
ORACLE["test_path"] = _with(S.FILES_BASE, _LANG) + f"""
SELECT f.path, regexp_extract({_MOVED}, '^(.*/)[^/]*$', 1) ||
  CASE WHEN lm.suffix IS NOT NULL THEN lm.prefix || {S.stem(_MOVED)} || lm.suffix
       ELSE {S.stem(_MOVED)} || 'Test' || {S.suffix(_MOVED)} END AS test_path
FROM files_base f JOIN lm ON lower({S.suffix('f.path')}) = lm.ext
WHERE NOT {S.has_part_in('f.path', K.CODE_IGNORE_DIRS)}"""

ORACLE["dominant_language"] = _with(S.FILES_BASE, _LANG) + f"""
, c AS (SELECT source, language, count(*) AS n_files FROM files_base f
        JOIN lm ON lower({S.suffix('f.path')}) = lm.ext GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_files DESC, language) AS r FROM c)
SELECT s.source, coalesce(t.language, 'Generic') AS language, CAST(coalesce(t.n_files, 0) AS BIGINT) AS n_files
FROM (SELECT DISTINCT source FROM files_base) s LEFT JOIN (SELECT * FROM t WHERE r = 1) t USING (source)"""



def _windows(src: str, text: str, keys: str, limit, sep_free: str = "part") -> str:
    """Rows (keys, window, n_windows, part): ``text`` cut into pieces of ``limit`` characters."""
    n = f"CAST(ceil(length({text}) / ({limit})::DOUBLE) AS BIGINT)"
    return f"""(SELECT {keys}, w AS "window", {n} AS n_windows, substring({text}, w * ({limit}) + 1, {limit}) AS {sep_free}
      FROM (SELECT *, unnest(range({n})) AS w FROM {src}))"""


def _merged(name: str, ans: str, keys: str, levels: int = 4) -> str:
    """CTE ``name`` (keys, resp): the answer, or the answers to the merge
    prompts over several, level by level."""
    ctes, done, level = [], [], ans
    for k in range(levels):
        done.append(f"SELECT {keys}, coalesce(resp, '') AS resp FROM {level} WHERE n_windows = 1")
        cat = f"""(SELECT {keys}, string_agg(coalesce(resp, ''), chr(10) || chr(10) ORDER BY "window") AS all_parts
      FROM {level} WHERE n_windows > 1 GROUP BY {keys})"""
        level = f"{name}_{k}"
        ctes.append(f"""{level}_raw AS (SELECT {keys}, "window", n_windows, {S.scripted('"user"')} AS resp
    FROM (SELECT *, {PR.user_sql('merge')} AS "user" FROM {_windows(cat, 'all_parts', keys, K.MAX_PAYLOAD_CHARS, 'parts')})),
{level} AS (SELECT * REPLACE ({S.final_of('resp')} AS resp) FROM {level}_raw)""")
    done.append(f"SELECT {keys}, coalesce(resp, '') AS resp FROM {level} WHERE n_windows = 1")
    return ",\n".join(ctes) + f",\n{name} AS ({' UNION ALL '.join(done)})"


ORACLE["concat_corpus"] = _with(S.FILES_BASE) + f"""
, g AS (SELECT source, count(*) AS n_files,
               CAST(sum(length(piece)) + 2 * (count(*) - 1) AS BIGINT) AS total_chars,
               string_agg(piece, chr(10) || chr(10) ORDER BY string_split(path, '/')) AS full_text
        FROM (SELECT source, path, '### File: ' || path || chr(10) || content AS piece
              FROM files_base WHERE {S.code_scan_where()})
        GROUP BY source)
SELECT source, "window", n_windows, n_files, total_chars, part AS payload
FROM {_windows('g', 'full_text', 'source, n_files, total_chars', K.MAX_PAYLOAD_CHARS)}"""

_TYPES = "dt(type_order, doc_type, label) AS (VALUES " + ", ".join(
    f"({i}, {S.lit(t)}, {S.lit(l)})" for i, (t, l) in enumerate(K.DOC_TYPES)) + ")"
ORACLE["doc_jobs"] = _with(S.FILES_BASE, _TYPES) + """
SELECT s.source, CAST(dt.type_order AS INTEGER) AS type_order, dt.doc_type, dt.label,
       'docs/' || dt.doc_type || '/' || s.source || '.md' AS dest_path
FROM (SELECT DISTINCT source FROM files_base) s CROSS JOIN dt"""

ORACLE["truncate_payload"] = f"""
SELECT doc_id, {S.truncate('text', K.MAX_PAYLOAD_CHARS, K.PAYLOAD_TRUNCATION_NOTICE)} AS payload,
       length(text) > {K.MAX_PAYLOAD_CHARS} AS truncated FROM documents"""

ORACLE["truncate_file"] = f"""
SELECT doc_id, {S.truncate('text', K.MAX_FILE_CHARS, K.TRUNCATED_MARKER)} AS content,
       length(text) > {K.MAX_FILE_CHARS} AS truncated FROM documents"""


# ------------------------------------------------- index lifecycle (3) -----
_UPD = _with(S.FILES_BASE, S.FILES_HEAD, _INDEX_CHUNKS) + f"""
, lm AS (SELECT file, max(coalesce(mtime, 0.0)) AS mtime FROM idx GROUP BY file),
cur AS (SELECT path AS file, mtime, content FROM files_head WHERE {S.index_scan_where()}),
deleted AS (SELECT file FROM lm WHERE file NOT IN (SELECT file FROM cur)),
changed AS (SELECT c.* FROM cur c LEFT JOIN lm l USING (file) WHERE l.file IS NULL OR c.mtime > l.mtime),
unchanged AS (SELECT c.file FROM cur c JOIN lm l USING (file) WHERE c.mtime <= l.mtime),
kept AS (SELECT * FROM idx WHERE file IN (SELECT file FROM unchanged)),
new AS ({S.chunks_of('changed', 'file, mtime')}),
merged AS (SELECT file, chunk_index, mtime, text FROM kept UNION ALL SELECT file, chunk_index, mtime, text FROM new)
"""

ORACLE["latest_mtime"] = _UPD + "SELECT file, mtime FROM lm"
ORACLE["files_deleted"] = _UPD + "SELECT file FROM deleted"
ORACLE["files_new_or_changed"] = _UPD + "SELECT file, mtime FROM changed"
ORACLE["chunks_kept"] = _UPD + "SELECT file, chunk_index, mtime FROM kept"
ORACLE["files_except"] = _UPD + "SELECT file FROM idx EXCEPT SELECT file FROM cur"
ORACLE["merge_index"] = _UPD + "SELECT file, chunk_index, mtime, length(text) AS n_chars FROM merged"
ORACLE["distinct_files"] = _UPD + "SELECT DISTINCT file FROM merged"
ORACLE["index_stats"] = _UPD + """
SELECT (SELECT count(*) FROM new) AS added,
       (SELECT count(*) FROM idx) - (SELECT count(*) FROM kept) AS removed,
       (SELECT count(*) FROM kept) AS unchanged"""
ORACLE["embed_progress"] = _with(S.FILES_BASE, _INDEX_CHUNKS) + """
SELECT file, chunk_index, row_number() OVER (PARTITION BY file ORDER BY chunk_index) AS current,
       count(*) OVER (PARTITION BY file) AS total FROM idx"""
ORACLE["build_index"] = _with(S.FILES_BASE, _INDEX_CHUNKS) + f"""
SELECT file, chunk_index, mtime, text, {K.EMBED_DIM} AS dim FROM idx"""
ORACLE["update_index"] = _UPD + f"SELECT file, chunk_index, mtime, text, {K.EMBED_DIM} AS dim FROM merged"
ORACLE["save_index"] = _with(S.FILES_BASE, _INDEX_CHUNKS) + f"""
SELECT file, chunk_index, mtime, {K.EMBED_DIM} AS dim FROM idx"""
ORACLE["load_index"] = _UPD + "SELECT file, chunk_index, mtime FROM merged"


# ------------------------------------------------------- responses (5) -----

ORACLE["parse_response_lines"] = _with(S.TOKENS, S.RESPONSE_LINES) + """
SELECT response_id, line_no, json_extract_string(line, '$.response') AS token FROM response_lines
WHERE json_valid(line) AND line <> '' AND json_type(line) = 'OBJECT' AND json_exists(line, '$.response')"""

ORACLE["split_reasoning"] = _with(S.TOKENS) + f"SELECT * FROM {S.split_reasoning()}"

_FENCE_S = S.py_strip("final")
_FENCE_L = S.splitlines(_FENCE_S)
ORACLE["strip_fence"] = _with(S.FENCED_ANSWERS) + f"""
SELECT response_id, CASE WHEN starts_with({_FENCE_S}, '```') AND len({_FENCE_L}) >= 2
                          AND starts_with({_FENCE_L}[-1], '```')
  THEN array_to_string({_FENCE_L}[2:len({_FENCE_L}) - 1], chr(10)) ELSE {_FENCE_S} END AS content
FROM fenced_answers"""

_OUT = S.py_strip("(coalesce(final, '') || coalesce(thinking, ''))")
ORACLE["verdict"] = _with(S.AUDIT_ANSWERS) + f"""
SELECT response_id, status, CASE WHEN status = 'clear' THEN 0 ELSE 1 END AS exit_code FROM (
  SELECT response_id, CASE WHEN length({_OUT}) = 0 THEN 'error'
    WHEN contains({_OUT}, {S.lit(K.ALL_CLEAR_SENTINEL)}) THEN 'clear' ELSE 'findings' END AS status
  FROM audit_answers)"""

_FIND = S.lit(r"^\s*\[?((?i:critical|high|medium|low))\]?\s*(?:\||\s-\s)\s*\[?(.*?)\]?\s*(?:\||\s-\s)\s*\[?(.*?)\]?\s*(?:\||\s-\s)\s*\[?(.*?)\]?\s*$")
ORACLE["findings"] = _with(S.AUDIT_ANSWERS) + f"""
SELECT response_id, CAST(line_no AS INTEGER) AS line_no, upper(regexp_extract(line, {_FIND}, 1)) AS severity,
  regexp_extract(line, {_FIND}, 2) AS location, regexp_extract(line, {_FIND}, 3) AS description,
  regexp_extract(line, {_FIND}, 4) AS remediation
FROM (SELECT response_id, unnest(string_split(final, chr(10))) AS line,
             unnest(range(len(string_split(final, chr(10))))) AS line_no FROM audit_answers)
WHERE regexp_matches(line, {_FIND})"""

ORACLE["final_text"] = _with(S.AUDIT_ANSWERS) + f"""
SELECT response_id, {S.py_strip("coalesce(final, '')")} AS answer,
       coalesce(length(final), 0) = 0 AND coalesce(length(thinking), 0) = 0 AS failed FROM audit_answers"""

ORACLE["visible_output"] = _with(S.TOKENS) + f"""
SELECT response_id, CASE WHEN length(shown) > 0 THEN shown ELSE {S.lit(RS.WAITING)} END AS shown FROM (
  SELECT response_id, concat_ws(chr(10) || chr(10), CASE WHEN length(thinking) > 0 THEN thinking END,
                                CASE WHEN length(final) > 0 THEN final END) AS shown
  FROM {S.split_reasoning()})"""


# ------------------------------------------- context, prompts, jobs (4) -----


def _hits(qsrc: str, k: int = K.TOP_K, same_root: bool = False) -> str:
    """CTEs ivec, qsrc, qvec, hits (query_id, file, chunk_index, distance, rank) + rhits with text/score.
    ``same_root``: a query's ``root`` is the first folder of every file that answers it."""
    pairs = "qvec q JOIN qsrc USING (query_id) JOIN ivec i ON split_part(i.file, '/', 1) = qsrc.root" if same_root else "qvec q, ivec i"
    return f""",
ivec AS {S.dense_embedding('idx', 'file, chunk_index')},
qsrc AS ({qsrc}),
qvec AS {S.dense_embedding('qsrc', 'query_id')},
hits AS (
  SELECT * FROM (
    SELECT query_id, file, chunk_index, distance,
           row_number() OVER (PARTITION BY query_id ORDER BY distance, file, chunk_index) AS rank
    FROM (SELECT query_id, i.file, i.chunk_index, {S.sql_distance('q.embedding', 'i.embedding')} AS distance
          FROM {pairs}))
  WHERE rank <= {k}),
rhits AS (SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.file, h.chunk_index, i.text, h.distance,
                 printf('%.4f', h.distance) AS score FROM hits h JOIN idx i USING (file, chunk_index))
"""


_BENCH_Q = "SELECT item_id AS query_id, text FROM benchmark"
_PROBE_Q = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {S.lit(p)})" for i, p in enumerate(K.PROBES)) + \
    ") t(query_id, text)"
_RH = _with(S.FILES_BASE, _INDEX_CHUNKS) + _hits(_BENCH_Q)
_PH = _with(S.FILES_BASE, _INDEX_CHUNKS) + _hits(_PROBE_Q)

ORACLE["hit_metadata"] = _with(_EXEMPLARS) + f"""
SELECT x.query_id, x.vec_id, CAST(x.rank AS INTEGER) AS rank, e2.label FROM (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
  FROM (SELECT q.query_id, e.vec_id, {S.sql_distance('q.qe', 'e.embedding')} AS distance
        FROM q, embeddings e)) x
JOIN embeddings e2 ON e2.vec_id = x.vec_id WHERE x.rank <= {K.TOP_K}"""
ORACLE["rank_hits"] = _RH + "SELECT query_id, file, chunk_index, rank FROM rhits"
ORACLE["format_score"] = _RH + "SELECT query_id, rank, score FROM rhits"
_BLK = "'--- Chunk ' || CAST(rank AS VARCHAR) || ' (file: ' || file"
ORACLE["context_block"] = _RH + f"""
SELECT query_id,
  string_agg({_BLK} || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg({_BLK} || ', score: ' || score || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)
    AS scored_context
FROM rhits GROUP BY query_id"""

ORACLE["retrieval_query"] = _with(S.FILES_BASE) + f"""
SELECT path, {S.lit(K.REVIEW_QUERY_PREFIX)} || substring(content, 1, {K.QUERY_PREFIX_CHARS}) AS review_query,
  {S.lit(K.AUDIT_QUERY_PREFIX)} || {S.py_strip(f"replace(substring(content, 1, {K.QUERY_PREFIX_CHARS}), chr(10), ' ')")}
    AS audit_query,
  {S.lit(K.TESTS_QUERY_PREFIX)} || {S.name('path')} AS tests_query FROM files_base"""

ORACLE["probe_queries"] = _PH + "SELECT query_id, rank, file, chunk_index, score FROM rhits"
_DEDUP = f"""dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY substring(text, 1, {K.DEDUP_PREFIX_CHARS})
                                  ORDER BY query_id, rank) AS r FROM rhits) WHERE r = 1)"""
ORACLE["dedup_hits"] = _PH + "," + _DEDUP + " SELECT query_id, rank, file, chunk_index FROM dd"

_BUDGET = CX.budget_chars()
def _map_ctes(files: str = "files_base", cond: str = "true", p: str = "") -> str:
    """C9's map step over the roots of ``files`` that ``cond`` admits: CTEs mf,
    mp, ms and the whole tree (tr) and summaries (sm) of each root, names with
    the prefix ``p``."""
    mf = f"(SELECT * FROM {p}mf WHERE NOT ({S.is_blank('content')}))"
    return f"""
, {p}mf AS (SELECT source, path, content, substring(path, length(source) + 2) AS rel_path FROM {files} f
         WHERE NOT {S.has_part_in('path', K.CODE_IGNORE_DIRS)}
           AND lower({S.suffix('path')}) IN (SELECT ext FROM lm) AND {_NOT_IGNORED} AND {cond}),
{p}mw AS (SELECT source, rel_path, "window", n_windows, part AS content FROM
       {_windows(mf, 'content', 'source, rel_path', K.MAX_FILE_CHARS)}),
{p}mp AS (SELECT source, rel_path, "window", n_windows, {PR.system_sql('summary')} AS system, {PR.user_sql('summary')} AS user FROM {p}mw),
{p}ma_raw AS (SELECT source, rel_path, "window", n_windows, {S.scripted('"user"')} AS resp FROM {p}mp),
{p}ma AS (SELECT * REPLACE ({S.final_of('resp')} AS resp) FROM {p}ma_raw),
{_merged(p + 'mr', p + 'ma', 'source, rel_path')},
{p}ms AS (SELECT source, rel_path, resp AS summary FROM {p}mr),
{p}tr AS (SELECT source, count(*) AS tree_files, CAST(sum(length(rel_path)) + count(*) - 1 AS BIGINT) AS tree_chars,
              string_agg(rel_path, chr(10) ORDER BY string_split(rel_path, '/')) AS tree
       FROM {p}mf GROUP BY source),
{p}sm AS (SELECT source, count(*) AS n_summaries, CAST(sum(length(piece)) + 2 * (count(*) - 1) AS BIGINT) AS summaries_chars,
              string_agg(piece, chr(10) || chr(10) ORDER BY string_split(rel_path, '/')) AS summaries
       FROM (SELECT source, rel_path, '### ' || rel_path || chr(10) ||
                    CASE WHEN summary IS NOT NULL AND length(summary) > 0 THEN summary ELSE {S.lit(CX.FAILED_SUMMARY)} END AS piece
             FROM {p}ms) GROUP BY source)
"""


_MAP = _with(S.FILES_BASE, _PAT_CTE, _LANG) + _map_ctes()


def _budget_sql(tr: str, sm: str) -> str:
    """CTE bp: T4's prompts, from the whole tree and summaries of each root."""
    mark = S.lit(K.TRUNCATED_MARKER)
    return f"""bz AS (SELECT source, tree, summaries, tree_chars + summaries_chars > {_BUDGET} AS cut,
    CASE WHEN tree_chars + summaries_chars > {_BUDGET} THEN least(tree_chars, {_BUDGET // 4}) ELSE tree_chars END AS bt,
    CASE WHEN tree_chars + summaries_chars > {_BUDGET} THEN {_BUDGET} - least(tree_chars, {_BUDGET // 4}) ELSE summaries_chars END AS bs
  FROM {tr} JOIN {sm} USING (source)),
bt AS (SELECT source, "window", n_windows AS nt, CASE WHEN "window" < n_windows - 1 THEN part || {mark} ELSE part END AS tree
       FROM {_windows('bz', 'tree', 'source', 'bt')}),
bs AS (SELECT source, "window", n_windows AS ns, CASE WHEN "window" < n_windows - 1 THEN part || {mark} ELSE part END AS summaries
       FROM {_windows('bz', 'summaries', 'source', 'bs')}),
bp AS (SELECT source, "window", max(greatest(coalesce(nt, 0), coalesce(ns, 0))) OVER (PARTITION BY source) AS n_windows,
              coalesce(bt.tree, '') AS tree, coalesce(bs.summaries, '') AS summaries, bz.cut
       FROM bt FULL OUTER JOIN bs USING (source, "window") JOIN (SELECT source, cut FROM bz) bz USING (source))"""


_BP = _MAP + "," + _budget_sql("tr", "sm")
_REPORT_ROWS = f"""ra_raw AS (SELECT source, "window", n_windows, {S.scripted('"user"')} AS resp FROM (SELECT *, {PR.user_sql('architect')} AS "user" FROM bp)),
ra AS (SELECT * REPLACE ({S.final_of('resp')} AS resp) FROM ra_raw),
{_merged('rm', 'ra', 'source')},
rp AS (SELECT source, {S.py_strip("coalesce(resp, '')")} AS report FROM rm)"""
_REPORT = _REPORT_ROWS + """
SELECT source, report, CASE WHEN length(report) = 0 THEN 'error' ELSE 'ok' END AS status FROM rp"""

ORACLE["prompt_summary"] = _MAP + 'SELECT source, rel_path, "window", system, user FROM mp'
ORACLE["generate_batch"] = _MAP + "SELECT source, rel_path, summary FROM ms"
ORACLE["file_tree"] = _MAP + f"""SELECT source, "window", n_windows, tree_files, tree_chars, part AS tree
FROM {_windows('tr', 'tree', 'source, tree_files, tree_chars', _BUDGET)}"""
ORACLE["summaries_concat"] = _MAP + f"""SELECT source, "window", n_windows, n_summaries, summaries_chars, part AS summaries
FROM {_windows('sm', 'summaries', 'source, n_summaries, summaries_chars', _BUDGET)}"""
ORACLE["budget_prompt"] = _BP + 'SELECT source, "window", n_windows, tree, summaries, cut FROM bp'
ORACLE["prompt_architect"] = _BP + f"""
SELECT source, "window", {PR.system_sql('architect')} AS system, {PR.user_sql('architect')} AS user FROM bp"""
ORACLE["analyze_map_reduce"] = _BP + "," + _REPORT

_ROOTS_PROBES = "SELECT root || '#' || query_id AS query_id, query_id AS probe, root, text FROM (" + _PROBE_Q + \
    ") p, (SELECT DISTINCT split_part(file, '/', 1) AS root FROM idx) r"
_IN_ROOT = "substring(file, length(split_part(file, '/', 1)) + 2)"
_SAMPLED = _with(S.FILES_BASE, _INDEX_CHUNKS) + _hits(_ROOTS_PROBES, same_root=True) + f"""
, dd AS (SELECT * FROM (SELECT h.*, qsrc.probe, qsrc.root, row_number() OVER (PARTITION BY root, substring(h.text, 1, {K.DEDUP_PREFIX_CHARS})
                                      ORDER BY probe, rank) AS r FROM rhits h JOIN qsrc USING (query_id)) WHERE r = 1),
sm AS (SELECT root AS source, CAST(sum(length(piece)) + 2 * (count(*) - 1) AS BIGINT) AS summaries_chars,
                string_agg(piece, chr(10) || chr(10) ORDER BY probe, rank) AS summaries
         FROM (SELECT root, probe, rank, '### ' || {_IN_ROOT} || chr(10) || text AS piece FROM dd) GROUP BY root),
tr AS (SELECT source, CAST(sum(length(file)) + count(*) - 1 AS BIGINT) AS tree_chars,
              string_agg(file, chr(10) ORDER BY string_split(file, '/')) AS tree
       FROM (SELECT DISTINCT split_part(file, '/', 1) AS source, {_IN_ROOT} AS file FROM idx) GROUP BY source)"""
ORACLE["analyze_sampled"] = _SAMPLED + f""",
{_budget_sql('tr', 'sm')},
{_REPORT}"""

# C9 for the roots of the later snapshot that the index of the earlier one lacks, C10 for the others
_BOTH = "source, {0}_chars, {0}"
ORACLE["analyze"] = _SAMPLED.replace(f"{S.FILES_BASE},", f"{S.FILES_BASE},\n{S.FILES_HEAD},\n{_PAT_CTE},\n{_LANG},", 1) \
    + _map_ctes("files_head", "source NOT IN (SELECT source FROM tr)", "f") + f"""
, hr AS (SELECT DISTINCT source FROM files_head f WHERE NOT {S.has_part_in('path', K.CODE_IGNORE_DIRS)}
  AND lower({S.suffix('path')}) IN (SELECT ext FROM lm) AND {_NOT_IGNORED}),
tr2 AS (SELECT {_BOTH.format('tree')} FROM tr WHERE source IN (SELECT source FROM hr) UNION ALL SELECT {_BOTH.format('tree')} FROM ftr),
sm2 AS (SELECT {_BOTH.format('summaries')} FROM sm UNION ALL SELECT {_BOTH.format('summaries')} FROM fsm),
{_budget_sql('tr2', 'sm2')},
{_REPORT}"""

_ASK = _RH + f"""
, ctx AS (SELECT query_id, string_agg({_BLK} || ', score: ' || score || ') ---' || chr(10) || text,
                                      chr(10) || chr(10) ORDER BY rank) AS context FROM rhits GROUP BY query_id),
ap AS (SELECT query_id, {PR.system_sql('ask')} AS system, {PR.user_sql('ask')} AS user
       FROM (SELECT b.item_id AS query_id, b.text AS question, c.context FROM benchmark b JOIN ctx c ON c.query_id = b.item_id))
"""
ORACLE["prompt_ask"] = _ASK + "SELECT query_id, system, user FROM ap"
_ASK_TOKENS = _ASK + f""", aa AS (SELECT query_id, {S.scripted('"user"')} AS resp FROM ap),
pieces AS (SELECT query_id AS response_id, seq, substring(resp, seq * 20 + 1, 20) AS chunk
       FROM (SELECT query_id, resp, unnest(range(CAST(ceil(length(coalesce(resp, '')) / 20) AS BIGINT))) AS seq FROM aa))"""
ORACLE["ask"] = _ASK_TOKENS + f"""
SELECT query_id, {S.py_strip("coalesce(final, '')")} AS answer, coalesce(length(final), 0) = 0 AND coalesce(length(thinking), 0) = 0 AS failed
FROM ap LEFT JOIN {S.split_reasoning('pieces')} ON response_id = query_id"""

_SC = """sc AS (SELECT coalesce(b.path, h.path) AS path,
           CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed'
                WHEN sha256(b.content) <> sha256(h.content) THEN 'modified' ELSE 'same' END AS status
         FROM files_base b FULL OUTER JOIN files_head h ON b.path = h.path)"""


def _snap(*extra: str) -> str:
    """CTEs files_base, files_head, sc (snapshot status) plus ``extra``."""
    return _with(S.FILES_BASE, S.FILES_HEAD, *extra, _SC)


_SNAP = _snap()
ORACLE["snapshot_changes"] = _SNAP + "SELECT path, status FROM sc"
ORACLE["modified_files"] = _snap(_LANG) + f"""
SELECT DISTINCT path FROM sc WHERE status IN ('added', 'modified') AND lower({S.suffix('path')}) IN (SELECT ext FROM lm)"""
ORACLE["changed_lines"] = _SNAP + """
, ch AS (SELECT path FROM sc WHERE status <> 'same'),
bl AS (SELECT path, line, count(*) AS n_base FROM (SELECT path, unnest(string_split(content, chr(10))) AS line
       FROM files_base WHERE path IN (SELECT path FROM ch)) GROUP BY ALL),
hl AS (SELECT path, line, count(*) AS n_head FROM (SELECT path, unnest(string_split(content, chr(10))) AS line
       FROM files_head WHERE path IN (SELECT path FROM ch)) GROUP BY ALL)
SELECT coalesce(bl.path, hl.path) AS path, coalesce(bl.line, hl.line) AS line,
       coalesce(n_base, 0) AS n_base, coalesce(n_head, 0) AS n_head, coalesce(n_head, 0) - coalesce(n_base, 0) AS delta
FROM bl FULL OUTER JOIN hl ON bl.path = hl.path AND bl.line = hl.line
WHERE coalesce(n_base, 0) <> coalesce(n_head, 0)"""


# --------------------------------------------------------- patches (6) -----


def _norm_sql(c: str) -> str:
    return f"array_to_string(list_transform({S.splitlines(c)}, lambda l: regexp_replace(l, {S.lit(TX_RSTRIP)}, '', 'g')), chr(10))"


_RE = S.lit(PTC.BLOCK_RE)


def _patch_base(answers: str, turn: str, of: str) -> str:
    """CTEs up to res, each patch's result. The patches of one ``turn`` (columns)
    are applied one after the other; ``of`` names the answer of a turn, if it has one."""
    return f"""WITH RECURSIVE {S.PATCH_RESPONSES},
{S.SECOND_ANSWERS},
{S.PATCH_FILES},
pl AS (SELECT response_id, regexp_extract_all(text, {_RE}, 1) AS fs, regexp_extract_all(text, {_RE}, 2) AS ss,
              regexp_extract_all(text, {_RE}, 3) AS rs FROM ({answers})),
pp AS (SELECT response_id, CAST(i AS INTEGER) AS patch_no, {S.py_strip('fs[i + 1]')} AS file, ss[i + 1] AS search,
              rs[i + 1] AS replace FROM (SELECT *, unnest(range(len(fs))) AS i FROM pl)),
tg AS (SELECT pp.*, f.content, f.content IS NOT NULL AS found,
              CASE WHEN f.content IS NULL THEN {S.lit(PTC.NOT_FOUND_FILE)} || pp.file END AS error
       FROM pp LEFT JOIN patch_files f ON f.path = pp.file),
sq AS (SELECT *, {of} AS answer, row_number() OVER (PARTITION BY {turn} ORDER BY response_id, patch_no) AS k FROM tg WHERE found),
fold AS (
  SELECT answer, answer AS response_id, file, CAST(0 AS BIGINT) AS k, content, CAST(NULL AS INTEGER) AS patch_no,
         CAST(NULL AS BOOLEAN) AS applied, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT DISTINCT answer, file, content FROM sq)
  UNION ALL
  SELECT s.answer, s.response_id, s.file, s.k,
    CASE WHEN strpos(f.content, s.search) > 0
           THEN substring(f.content, 1, strpos(f.content, s.search) - 1) || s.replace
                || substring(f.content, strpos(f.content, s.search) + length(s.search))
         WHEN strpos({_norm_sql('f.content')}, {_norm_sql('s.search')}) > 0
           THEN substring({_norm_sql('f.content')}, 1, strpos({_norm_sql('f.content')}, {_norm_sql('s.search')}) - 1)
                || s.replace || substring({_norm_sql('f.content')},
                     strpos({_norm_sql('f.content')}, {_norm_sql('s.search')}) + length({_norm_sql('s.search')}))
         ELSE f.content END,
    s.patch_no,
    strpos(f.content, s.search) > 0 OR strpos({_norm_sql('f.content')}, {_norm_sql('s.search')}) > 0,
    CASE WHEN strpos(f.content, s.search) > 0 OR strpos({_norm_sql('f.content')}, {_norm_sql('s.search')}) > 0
         THEN NULL ELSE {S.lit(PTC.NOT_FOUND_TEXT)} || s.file END
  FROM fold f JOIN sq s ON s.answer = f.answer AND s.file = f.file AND s.k = f.k + 1),
res AS (SELECT response_id, patch_no, applied, error FROM fold WHERE patch_no IS NOT NULL
        UNION ALL SELECT response_id, patch_no, false, error FROM tg WHERE NOT found)
"""


_PATCH_BASE = _patch_base("SELECT * FROM patch_responses", "response_id, file", "response_id")
ORACLE["parse_patches"] = _PATCH_BASE + "SELECT response_id, patch_no, file, search, replace FROM pp"
ORACLE["preview_patch"] = _PATCH_BASE + f"""
SELECT response_id, patch_no, file, substring(search, 1, {K.PREVIEW_CHARS}) AS search_preview,
       substring(replace, 1, {K.PREVIEW_CHARS}) AS replace_preview FROM pp"""
ORACLE["patch_targets"] = _PATCH_BASE + "SELECT response_id, patch_no, file, found, error FROM tg"
ORACLE["apply_patches"] = _PATCH_BASE + "SELECT * FROM res"
ORACLE["patch_summary"] = _PATCH_BASE + """
SELECT response_id, count(*) AS total, count(*) FILTER (WHERE applied) AS applied FROM res GROUP BY response_id"""
# the blocks of both answers to a file, one after the other
_SNAPSHOT = _patch_base("SELECT * FROM patch_responses UNION ALL SELECT * FROM second_answers", "file", "CAST(0 AS BIGINT)")
ORACLE["write_patched"] = _SNAPSHOT + """, n AS (SELECT file, arg_max(content, k) AS new, count(*) FILTER (applied) AS a, count(*) FILTER (NOT applied) AS f FROM fold GROUP BY file)
SELECT path, coalesce(new, content) AS content, coalesce(a, 0) AS n_applied, coalesce(f, 0) AS n_failed
FROM patch_files LEFT JOIN n ON n.file = path"""
ORACLE["patch_conflicts"] = _SNAPSHOT + """
SELECT r.response_id, r.patch_no, pp.file, r.applied, r.error,
       coalesce(NOT r.applied AND strpos(p.content, pp.search) > 0, false) AS conflict
FROM res r JOIN pp ON pp.response_id = r.response_id AND pp.patch_no = r.patch_no LEFT JOIN patch_files p ON p.path = pp.file"""


# ------------------------------------------------------------ jobs (7) -----
_CS = _SNAP + f"""
, cp AS (SELECT sc.path, sc.status, coalesce(h.source, b.source) AS source,
    '--- ' || sc.status || ' ' || sc.path || chr(10) ||
    CASE sc.status WHEN 'added' THEN '+' || h.content WHEN 'removed' THEN '-' || b.content
         ELSE '-' || b.content || chr(10) || '+' || h.content END AS diff
  FROM sc LEFT JOIN files_base b ON b.path = sc.path LEFT JOIN files_head h ON h.path = sc.path
  WHERE sc.status <> 'same'),
cs0 AS (SELECT source, count(*) AS n_files, sum(length(diff)) + count(*) - 1 AS total_chars,
               string_agg(diff, chr(10) ORDER BY string_split(path, '/')) AS diff_text FROM cp GROUP BY source),
css AS {_windows('cs0', 'diff_text', 'source, n_files', K.MAX_PAYLOAD_CHARS, 'diff')}
"""


ORACLE["prompt_commit"] = _CS + f"""
SELECT source, "window", {PR.system_sql('commit')} AS system, {PR.user_sql('commit')} AS user FROM css"""
ORACLE["commit_messages"] = _CS + f"""
, ca AS (SELECT source, "window", n_windows, {S.scripted('"user"')} AS resp FROM (SELECT *, {PR.user_sql('commit')} AS "user" FROM css)),
{_merged('cm', 'ca', 'source')}
SELECT source, {S.py_strip("coalesce(resp, '')")} AS message FROM cm"""

_WKEY = "source || '#' || \"window\""


def _ctx_from(qsrc: str) -> str:
    return _hits(qsrc, same_root=True) + f""", ctx AS (SELECT query_id, string_agg({_BLK} || ') ---' || chr(10) || text,
                                         chr(10) || chr(10) ORDER BY rank) AS context FROM rhits GROUP BY query_id)
"""


_REVIEW = (_CS
           + f", {_INDEX_CHUNKS}"
           + _ctx_from(f"SELECT {_WKEY} AS query_id, {S.lit(K.REVIEW_QUERY_PREFIX)} || substring(diff, 1, {K.QUERY_PREFIX_CHARS}) AS text, source AS root FROM css")
           + f""", rp AS (SELECT source, "window", n_windows, fix, {PR.system_sql('review')} AS system, {PR.user_sql('review')} AS user
  FROM (SELECT c.*, x.context, length(c.source) % 2 = 0 AS fix FROM css c LEFT JOIN ctx x ON x.query_id = {_WKEY.replace('source', 'c.source')}))
""")
ORACLE["prompt_review"] = _REVIEW + 'SELECT source, "window", fix, system, user FROM rp'
ORACLE["review"] = _REVIEW + f"""
, ra_raw AS (SELECT source, "window", n_windows, {S.scripted('"user"')} AS resp FROM rp),
ra AS (SELECT source, "window", n_windows, {S.final_of('resp')} AS resp, {S.thinking_of('resp')} AS thinking FROM ra_raw),
{_merged('rm', 'ra', 'source')},
rf AS (SELECT source, bool_or(length(resp) = 0 AND length(thinking) = 0) AS failed, CAST(sum(len(regexp_extract_all(resp, {S.lit(PTC.BLOCK_RE)}, 1))) AS BIGINT) AS n_patches
       FROM ra GROUP BY source)
SELECT source, {S.py_strip("coalesce(resp, '')")} AS review, failed, n_patches FROM rm JOIN rf USING (source)"""


def _corpus_windows(content: str) -> str:
    return f"""pay AS {_windows(f"(SELECT source, string_agg(piece, chr(10) || chr(10) ORDER BY string_split(path, '/')) AS full_text FROM (SELECT source, path, '### File: ' || path || chr(10) || {content} AS piece FROM files_base WHERE {S.code_scan_where()}) GROUP BY source)", 'full_text', 'source', K.MAX_PAYLOAD_CHARS, 'code')}"""


_UNSUPPRESSED = ("array_to_string(list_filter(string_split(content, chr(10)), "
                 "lambda l: NOT regexp_matches(l, '(//|#)[ \\t]*[A-Za-z0-9_.-]*ignore-sec[ \\t\\r]*$')), chr(10))")
_AUQ = (f"{S.lit(K.AUDIT_QUERY_PREFIX)} || "
        + S.py_strip(f"replace(substring(code, 1, {K.QUERY_PREFIX_CHARS}), chr(10), ' ')"))
_AUDIT = (_with(S.FILES_BASE, _INDEX_CHUNKS, _corpus_windows(_UNSUPPRESSED))
          + _ctx_from(f"SELECT {_WKEY} AS query_id, {_AUQ} AS text, source AS root FROM pay")
          + f""", ap AS (SELECT source, "window", fix, {PR.system_sql('audit')} AS system, {PR.user_sql('audit')} AS user
  FROM (SELECT p.*, x.context, length(p.source) % 2 = 0 AS fix FROM pay p LEFT JOIN ctx x ON x.query_id = {_WKEY.replace('source', 'p.source')}))
""")
_VOUT = S.py_strip("(resp || thinking)")
ORACLE["prompt_audit"] = _AUDIT + 'SELECT source, "window", fix, system, user FROM ap'
ORACLE["audit"] = _AUDIT + f"""
, aa_raw AS (SELECT source, "window", {S.scripted('"user"')} AS resp FROM ap),
aa AS (SELECT source, {S.final_of('resp')} AS resp, {S.thinking_of('resp')} AS thinking FROM aa_raw),
v AS (SELECT source, resp, CASE WHEN length({_VOUT}) = 0 THEN 1 WHEN contains({_VOUT}, {S.lit(K.ALL_CLEAR_SENTINEL)}) THEN 0 ELSE 2 END AS rank FROM aa)
SELECT source, ['clear', 'error', 'findings'][max(rank) + 1] AS status, CASE WHEN max(rank) = 0 THEN 0 ELSE 1 END AS exit_code,
  CAST(sum(len(list_filter(string_split(resp, chr(10)), lambda l: regexp_matches(l, {_FIND})))) AS BIGINT) AS n_findings
FROM v GROUP BY source"""

_DOCS = _with(S.FILES_BASE, _LANG, _TYPES, S.EXISTING_DOCS, _corpus_windows("content")) + f"""
, c AS (SELECT source, language, count(*) AS n FROM files_base f JOIN lm ON lower({S.suffix('f.path')}) = lm.ext GROUP BY ALL),
dl AS (SELECT s.source, coalesce(t.language, 'Generic') AS language FROM (SELECT DISTINCT source FROM files_base) s
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, language) AS r FROM c)
                  WHERE r = 1) t USING (source)),
jobs AS (SELECT p.source, p."window", p.n_windows, p.code, dl.language, dt.doc_type, dt.label, dt.type_order,
                'docs/' || dt.doc_type || '/' || p.source || '.md' AS dest_path, e.content AS existing,
                e.content IS NOT NULL AS is_update, CAST(NULL AS VARCHAR) AS hint
         FROM pay p JOIN dl USING (source) CROSS JOIN dt
         LEFT JOIN existing_docs e ON e.path = 'docs/' || dt.doc_type || '/' || p.source || '.md'),
dp AS (SELECT *, {PR.system_sql('doc')} AS system, {PR.user_sql('doc')} AS user FROM jobs),
da_raw AS (SELECT source, doc_type, label, dest_path, is_update, "window", n_windows, {S.scripted('"user"')} AS resp FROM dp),
da AS (SELECT * REPLACE ({S.final_of('resp')} AS resp) FROM da_raw),
{_merged('dm', 'da', 'source, doc_type, label, dest_path, is_update')},
dr AS (SELECT source, doc_type, label, dest_path, is_update, {S.py_strip("coalesce(resp, '')")} AS doc FROM dm),
dres AS (SELECT *, CASE WHEN length(doc) = 0 THEN 'empty' WHEN is_update THEN 'updated' ELSE 'created' END AS status FROM dr)
"""
ORACLE["docs_existing"] = _with(S.FILES_BASE, _TYPES, S.EXISTING_DOCS) + """
SELECT s.source, dt.doc_type, 'docs/' || dt.doc_type || '/' || s.source || '.md' AS dest_path, e.path IS NOT NULL AS is_update
FROM (SELECT DISTINCT source FROM files_base) s CROSS JOIN dt
LEFT JOIN existing_docs e ON e.path = 'docs/' || dt.doc_type || '/' || s.source || '.md'"""
ORACLE["prompt_doc"] = _DOCS + 'SELECT source, doc_type, "window", system, user FROM dp'
ORACLE["generate_docs"] = _DOCS + "SELECT source, doc_type, dest_path, status, doc FROM dres"
ORACLE["write_generated"] = _DOCS + "SELECT doc_type, dest_path, doc FROM dres WHERE status <> 'empty'"
ORACLE["job_summary"] = _DOCS + "SELECT label, status, count(*) AS n_jobs FROM dres GROUP BY ALL"

_TM = "replace(m.path, 'src/', 'tests/')"
_TESTS = _snap(_LANG, _INDEX_CHUNKS) + f"""
, mod AS (SELECT DISTINCT path FROM sc WHERE status IN ('added', 'modified') AND lower({S.suffix('path')}) IN (SELECT ext FROM lm)),
tp AS (SELECT m.path, regexp_extract({_TM}, '^(.*/)[^/]*$', 1) ||
         CASE WHEN lm.suffix IS NOT NULL THEN lm.prefix || {S.stem(_TM)} || lm.suffix
              ELSE {S.stem(_TM)} || 'Test' || {S.suffix(_TM)} END AS test_path,
         lm.language, lm.framework
       FROM mod m JOIN lm ON lower({S.suffix('m.path')}) = lm.ext),
te0 AS (SELECT tp.*, e.content AS existing, e.content IS NOT NULL AS is_update, h.content AS code,
              CASE WHEN e.content IS NOT NULL THEN 'update' ELSE 'new' END AS mode
       FROM tp LEFT JOIN files_head e ON e.path = tp.test_path JOIN files_head h ON h.path = tp.path)
{_ctx_from(f"SELECT path AS query_id, {S.lit(K.TESTS_QUERY_PREFIX)} || {S.name('path')} AS text, split_part(path, '/', 1) AS root FROM te0")},
te AS (SELECT te0.*, ctx.context FROM te0 LEFT JOIN ctx ON ctx.query_id = te0.path),
tpr AS (SELECT path, test_path, is_update, {PR.system_sql('test')} AS system, {PR.user_sql('test')} AS user FROM te),
tans_raw AS (SELECT path, test_path, is_update, {S.scripted('"user"')} AS resp FROM tpr),
tans AS (SELECT * REPLACE ({S.final_of('resp')} AS resp) FROM tans_raw)
"""
_FS = S.py_strip("coalesce(resp, '')")
_FL = S.splitlines(_FS)
_TPLAN = f"""SELECT path, test_path AS dest_path,
  CASE WHEN starts_with({_FS}, '```') AND len({_FL}) >= 2 AND starts_with({_FL}[-1], '```')
       THEN array_to_string({_FL}[2:len({_FL}) - 1], chr(10)) ELSE {_FS} END AS content,
  CASE WHEN length(coalesce(resp, '')) = 0 THEN 'skip' WHEN is_update THEN 'update' ELSE 'create' END AS action
FROM tans"""
ORACLE["tests_existing"] = _TESTS + "SELECT path, test_path, language, framework, is_update FROM te"
ORACLE["prompt_test"] = _TESTS + "SELECT path, test_path, system, user FROM tpr"
ORACLE["generate_tests"] = _TESTS + _TPLAN
ORACLE["write_tests"] = _TESTS + f", pl AS ({_TPLAN}) SELECT dest_path, content, action FROM pl WHERE action <> 'skip'"
ORACLE["write_report"] = _BP + "," + _REPORT_ROWS + """
SELECT source, report FROM rp WHERE length(report) > 0"""

_ROUTES = "rt(purpose, model, num_ctx, num_predict) AS (VALUES " + ", ".join(
    f"({S.lit(p)}, {S.lit(m)}, {c}, {n})" for p, m, c, n in K.ROUTES) + ")"
ORACLE["route_model"] = _with(_ROUTES) + f"""
SELECT d.doc_id, d.purpose, coalesce(nullif(rt.model, ''), {S.lit(K.DEFAULT_MODEL)}) AS model,
       CAST(coalesce(rt.num_ctx, {K.DEFAULT_NUM_CTX}) AS INTEGER) AS num_ctx,
       CAST(coalesce(rt.num_predict, {K.DEFAULT_NUM_PREDICT}) AS INTEGER) AS num_predict
FROM (SELECT doc_id, {S.str_list(PURPOSES)}[doc_id % {len(PURPOSES)} + 1] AS purpose FROM documents) d
LEFT JOIN rt ON rt.purpose = d.purpose"""


# ------------------------------------------------------- streaming (X) -----


def _reasoning_rows(src: str) -> str:
    return f"""
SELECT response_id, seq, think_piece AS thinking_delta, final_piece AS final_delta,
  CAST(sum(length(think_piece)) OVER w AS BIGINT) AS thinking_len,
  CAST(sum(length(final_piece)) OVER w AS BIGINT) AS final_len, is_thinking
FROM {S.reasoning_pieces(src)}
WINDOW w AS (PARTITION BY response_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


ORACLE["split_reasoning_stream"] = _with(S.TOKENS) + _reasoning_rows("tokens")
ORACLE["generate_stream"] = _ASK_TOKENS + _reasoning_rows("pieces")
ORACLE["response_stream"] = ORACLE["parse_response_lines"]
ORACLE["update_index_stream"] = ORACLE["load_index"]

ORACLE["doc_path"] = _with(S.FILES_BASE, _TYPES) + """
SELECT s.source, dt.doc_type, 'docs/' || dt.doc_type || '/' || s.source || '.md' AS dest_path
FROM (SELECT DISTINCT source FROM files_base) s CROSS JOIN dt"""
