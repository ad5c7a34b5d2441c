"""DuckDB SQL fragments mirroring the Spark views and column functions.

Used only to build the oracle queries in ``quarry.checks.oracle``; the engine
itself never runs these strings.
"""

from __future__ import annotations

from quarry import constants as K
from quarry.functions import text as TX
from quarry.functions.embed import TOKEN_RE, hex_digits
from quarry.sources import corpus_views as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def suffix(p: str) -> str:
    return f"regexp_extract({name(p)}, '^.+(\\.[^.]+)$', 1)"


def stem(p: str) -> str:
    return (f"CASE WHEN length({suffix(p)}) > 0 THEN regexp_extract({name(p)}, '^(.+)\\.[^.]+$', 1) "
            f"ELSE {name(p)} END")


def has_part_in(p: str, names) -> str:
    return f"list_has_any(string_split({p}, '/'), {str_list(names)})"


def py_strip(c: str) -> str:
    return f"regexp_replace({c}, {lit(TX.STRIP_RE)}, '', 'g')"


def is_blank(c: str) -> str:
    return f"NOT regexp_matches({c}, {lit(TX.NON_BLANK_RE)})"


def truncate(c: str, limit: int, notice: str) -> str:
    return f"CASE WHEN length({c}) > {limit} THEN substring({c}, 1, {limit}) || {lit(notice)} ELSE {c} END"


def bucket(tok: str, dim: int = K.EMBED_DIM) -> str:
    h = hex_digits(dim)
    terms = [f"(instr('0123456789abcdef', substr(md5({tok}), {i + 1}, 1)) - 1) * {16 ** (h - 1 - i)}"
             for i in range(h)]
    return "(" + " + ".join(terms) + ")"


def pick(values, idx: str) -> str:
    return f"{str_list(values)}[{idx} + 1]"


FILES_BASE = f"""files_base AS (
  SELECT source || '/' || {pick(V.DIRS, 'doc_id % 7')} || '/f' || CAST(doc_id AS VARCHAR)
         || {pick(V.EXTS, 'doc_id % 9')} AS path,
         CAST({V.BASE_MTIME} + doc_id AS DOUBLE) AS mtime, text AS content, source, doc_id
  FROM documents)"""

FILES_HEAD = f"""files_head AS (
  SELECT path,
         CASE WHEN doc_id % 10 = 1 THEN mtime + 1 WHEN doc_id % 10 = 2 THEN mtime - 1 ELSE mtime END AS mtime,
         CASE WHEN doc_id % 10 IN (1, 2) THEN content || ' changed' ELSE content END AS content,
         source, doc_id
  FROM files_base WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT 'bench/b' || CAST(item_id AS VARCHAR) || '.py', CAST({V.NEW_FILE_MTIME} AS DOUBLE), text, 'bench',
         CAST(NULL AS BIGINT)
  FROM benchmark)"""

_P = V.TOKEN_PIECE
_RAW = f"substring(text, seq * {_P} + 1, {_P})"
TOKENS = f"""tokens AS (
  SELECT response_id, CAST(seq AS BIGINT) AS seq,
    CASE WHEN mode = 1 AND seq = 0 THEN 'a</think>b</think>' || {_RAW}
         WHEN mode = 2 AND seq = 0 THEN {_RAW} || '<thi'
         WHEN mode = 2 AND seq = 1 THEN 'nk>' || {_RAW}
         WHEN mode IN (3, 4) AND seq = 0 THEN 'lead <think>' || {_RAW}
         WHEN mode IN (3, 4) AND seq = 2 THEN substring({_RAW}, 1, 10) || '</think>' || substring({_RAW}, 11)
         ELSE {_RAW} END AS chunk
  FROM (SELECT conv_id * 1000 + turn AS response_id, conv_id % 5 AS mode, text,
               unnest(range(0, CAST(ceil(length(text) / {_P}) AS BIGINT))) AS seq
        FROM conversations WHERE role = 'assistant'))"""

_SEARCH = ("CASE WHEN doc_id % 4 = 1 THEN 'absent text ' || CAST(doc_id AS VARCHAR) "
           "WHEN doc_id % 4 = 3 THEN substring(text, 1, 40) || '  ' ELSE substring(text, 1, 40) END")
_TARGET = ("CASE WHEN doc_id % 4 = 2 THEN 'missing/' || CAST(doc_id AS VARCHAR) "
           "ELSE 'src/f' || CAST(doc_id AS VARCHAR) || '.py' END")
PATCH_RESPONSES = f"""patch_responses AS (
  SELECT doc_id AS response_id,
    'Suggested fixes for document ' || CAST(doc_id AS VARCHAR) || '.' || chr(10)
    || '<<<< SEARCH file:' || {_TARGET} || chr(10) || {_SEARCH} || chr(10) || '==== REPLACE' || chr(10)
    || {lit(V.FIRST_REPLACEMENT)} || chr(10) || '>>>>' || chr(10)
    || 'Then:' || chr(10) || '<<<< SEARCH file: ' || {_TARGET} || ' ' || chr(10)
    || {lit(V.FIRST_REPLACEMENT)} || chr(10) || '==== REPLACE' || chr(10)
    || {lit(V.SECOND_REPLACEMENT)} || chr(10) || '>>>>' || chr(10) AS text
  FROM documents)"""

SECOND_ANSWERS = f"""second_answers AS (
  SELECT doc_id + {V.SECOND_ANSWERS_FROM} AS response_id,
    '<<<< SEARCH file:' || {_TARGET} || chr(10) || 'patched_twice = True' || chr(10) || '==== REPLACE' || chr(10)
    || {lit(V.THIRD_REPLACEMENT)} || chr(10) || '>>>>' || chr(10)
    || '<<<< SEARCH file:' || {_TARGET} || chr(10) || substring(text, 1, 40) || chr(10) || '==== REPLACE' || chr(10)
    || {lit(V.FIRST_REPLACEMENT)} || chr(10) || '>>>>' || chr(10) AS text
  FROM documents)"""

PATCH_FILES = """patch_files AS (
  SELECT 'src/f' || CAST(doc_id AS VARCHAR) || '.py' AS path, text AS content FROM documents)"""


def chunks_of(src: str, key_cols: str, text_col: str = "content",
              size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> str:
    """G1 over ``src``: ``key_cols, chunk_index, text``."""
    step = size - overlap
    return (f"SELECT {key_cols}, CAST(s // {step} AS INTEGER) AS chunk_index, "
            f"substring(_t, s + 1, {size}) AS text FROM (SELECT {key_cols}, {text_col} AS _t, "
            f"unnest(range(0, length({text_col}), {step})) AS s FROM {src})")


def index_scan_where(p: str = "path") -> str:
    return (f"NOT {has_part_in(p, K.INDEX_IGNORE_DIRS)} AND lower({suffix(p)}) IN "
            f"({', '.join(lit(e) for e in K.INDEX_EXTENSIONS)})")


def code_scan_where(p: str = "path") -> str:
    return (f"NOT {has_part_in(p, K.CODE_IGNORE_DIRS)} AND lower({suffix(p)}) IN "
            f"({', '.join(lit(e) for e in K.CODE_EXTENSIONS)})")


def index_chunks(files: str = "files_base") -> str:
    """C1 chunk rows: ``file, mtime, chunk_index, text``."""
    src = f"(SELECT path AS file, mtime, content FROM {files} WHERE {index_scan_where()})"
    return chunks_of(src, "file, mtime")


def sparse_embedding(src: str, key_cols: str, dim: int = K.EMBED_DIM) -> str:
    """E1 in sparse form: ``key_cols, bucket, cnt, norm`` for non-zero buckets."""
    return f"""(SELECT {key_cols}, bucket, cnt, sqrt(sum(cnt * cnt) OVER (PARTITION BY {key_cols})) AS norm
  FROM (SELECT {key_cols}, {bucket('tok', dim)} AS bucket, count(*) AS cnt
        FROM (SELECT {key_cols}, unnest(regexp_extract_all(lower(text), {lit(TOKEN_RE)})) AS tok FROM {src})
        GROUP BY ALL))"""


def dense_embedding(src: str, key_cols: str, dim: int = K.EMBED_DIM) -> str:
    """E1 dense: ``key_cols, embedding FLOAT[dim]`` (all-zero when no tokens)."""
    sp = sparse_embedding(src, key_cols, dim)
    cols = [c.strip() for c in key_cols.split(",")]
    on = " AND ".join(f"e.{c} = k.{c}" for c in cols)
    kc = ", ".join(f"k.{c}" for c in cols)
    return f"""(SELECT {kc}, list(CAST(coalesce(e.cnt / e.norm, 0.0) AS FLOAT) ORDER BY r.j) AS embedding
  FROM (SELECT DISTINCT {key_cols} FROM {src}) k CROSS JOIN range({dim}) r(j)
  LEFT JOIN {sp} e ON {on} AND e.bucket = r.j
  GROUP BY {kc})"""


def sql_distance(a: str, b: str) -> str:
    """Squared L2 distance summed in dimension order (matches the Spark side)."""
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda j: "
            f"(CAST({a}[j] AS DOUBLE) - CAST({b}[j] AS DOUBLE)) * (CAST({a}[j] AS DOUBLE) - CAST({b}[j] AS DOUBLE))), "
            f"lambda x, y: x + y)")


RESPONSE_LINES = f"""response_lines AS (
  SELECT response_id, seq * 2 AS line_no, to_json({{'response': chunk}})::VARCHAR AS line FROM tokens
  UNION ALL SELECT response_id, seq * 2 + 1, {lit(V.MALFORMED_LINE)} FROM tokens WHERE seq % 7 = 3
  UNION ALL SELECT response_id, seq * 2 + 1, '' FROM tokens WHERE seq % 11 = 5
  UNION ALL SELECT DISTINCT response_id, CAST({V.DONE_LINE_NO} AS BIGINT), {lit(V.DONE_LINE)} FROM tokens)"""

AUDIT_ANSWERS = f"""audit_answers AS (
  SELECT conv_id * 1000 + turn AS response_id,
    CASE conv_id % 4 WHEN 0 THEN text || chr(10) || 'NO_VULNERABILITIES_FOUND' WHEN 1 THEN ''
      WHEN 2 THEN array_to_string(list_transform(string_split(text, chr(10)),
                  lambda l: {lit(V.FINDING_PREFIX)} || l || {lit(V.FINDING_SUFFIX)}), chr(10))
      ELSE text END AS final,
    CASE WHEN conv_id % 4 = 1 THEN text ELSE '' END AS thinking
  FROM conversations WHERE role = 'assistant')"""

FENCED_ANSWERS = """fenced_answers AS (
  SELECT conv_id * 1000 + turn AS response_id,
    CASE conv_id % 3 WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```'
      WHEN 1 THEN '  ```' || chr(10) || text ELSE text END AS final
  FROM conversations WHERE role = 'assistant')"""


def splitlines(c: str) -> str:
    """Python str.splitlines() on DuckDB (no trailing empty element)."""
    parts = f"string_split_regex({c}, {lit(TX.LINE_BREAK)})"
    return (f"(CASE WHEN length({c}) = 0 THEN []::VARCHAR[] WHEN regexp_matches({c}, {lit('(?:' + TX.LINE_BREAK + ')' + chr(92) + 'z')}) "
            f"THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)")


def reasoning_pieces(src: str = "tokens") -> str:
    """W3 per-token pieces: ``response_id, seq, think_piece, final_piece, is_thinking``."""
    return f"""(SELECT response_id, seq,
    CASE WHEN cl THEN parts[1] WHEN op OR coalesce(bef, false) THEN c ELSE '' END AS think_piece,
    CASE WHEN cl THEN coalesce(parts[2], '') WHEN NOT (op OR coalesce(bef, false)) THEN c ELSE '' END AS final_piece,
    coalesce(cur, false) AS is_thinking
  FROM (SELECT *,
      last_value(aft IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef,
      last_value(aft IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur
    FROM (SELECT response_id, seq, c, op, contains(c, '</think>') AS cl, string_split(c, '</think>') AS parts,
                 CASE WHEN contains(c, '</think>') THEN false WHEN op THEN true END AS aft
          FROM (SELECT response_id, seq, replace(chunk, '<think>', '') AS c, contains(chunk, '<think>') AS op
                FROM {src}))))"""


def split_reasoning(src: str = "tokens") -> str:
    return f"""(SELECT response_id, string_agg(think_piece, '' ORDER BY seq) AS thinking,
    string_agg(final_piece, '' ORDER BY seq) AS final, arg_max(is_thinking, seq) AS is_thinking
  FROM {reasoning_pieces(src)} GROUP BY response_id)"""


def default_answer(c: str) -> str:
    """M1 offline default: first three non-blank lines, stripped."""
    return py_strip(f"array_to_string(list_filter(string_split_regex({c}, {lit(TX.LINE_BREAK)}), "
                    f"lambda l: regexp_matches(l, {lit(TX.NON_BLANK_RE)}))[1:3], chr(10))")


def scripted(c: str) -> str:
    """The stand-in model of the views: one of eight kinds of answer."""
    plain = default_answer(c)
    return (f"CASE length({c}) % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN {plain} || chr(10) || 'NO_VULNERABILITIES_FOUND' "
            f"WHEN 3 THEN {lit(V.SCRIPT_FINDINGS)} || {plain} WHEN 4 THEN '<think>first' || chr(10) || substring({plain}, 1, 20) || '</think>' || {plain} "
            f"WHEN 5 THEN {plain} || {lit(V.SCRIPT_BLOCK)} WHEN 6 THEN '<think>only ' || {plain} ELSE {plain} END")


def final_of(c: str) -> str:
    """W3 on a whole answer: the text after the reasoning."""
    c = f"coalesce({c}, '')"
    return (f"(CASE WHEN contains({c}, '</think>') THEN string_split(replace({c}, '<think>', ''), '</think>')[2] "
            f"WHEN contains({c}, '<think>') THEN '' ELSE {c} END)")


def thinking_of(c: str) -> str:
    c = f"coalesce({c}, '')"
    return (f"(CASE WHEN contains({c}, '</think>') THEN string_split(replace({c}, '<think>', ''), '</think>')[1] "
            f"WHEN contains({c}, '<think>') THEN replace({c}, '<think>', '') ELSE '' END)")


EXISTING_DOCS = """existing_docs AS (
  SELECT 'docs/tutorial/' || source || '.md' AS path, 'Earlier tutorial for ' || source AS content
  FROM (SELECT DISTINCT source FROM files_base)
  WHERE length(regexp_extract(source, '(\\d+)$', 1)) > 0 AND CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) < 5)"""
