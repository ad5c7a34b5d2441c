"""The registered queries ``opN_<name>`` of the training-data operators, each
over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, decontamination, embeddings, fingerprints, lm_score, merkle, neardup, records, runs, sharding, substrings, toxicity
from quarry.llm.common import scratch_path, sha256_text, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, 85 percent."""
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's record, read back from the files it was written to."""
    path = scratch_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=2)
    back = records.read_records(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document, 13-word windows."""
    out = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), matches=False)
    hit = decontamination.n_hit(F.col("spans"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      sha256_text(F.array_join("items", ",")).alias("items_sha256"),
                      decontamination.contaminated(F.col("n_words"), hit).alias("contaminated"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, 64 shards, keyed by doc_id."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"],
                          [f"shard-{i:04d}" for i in range(64)], spread=["text"])


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document's words under a network trained on all."""
    docs = table(spark, sf_dir, "documents")
    counts = lm_score.word_counts(docs)
    return lm_score.score(docs, lm_score.fit(docs, counts=counts), counts=counts)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, read back from the output."""
    hard = spark.sql(r"""SELECT -7L AS conv_id, t AS turn, r AS role, r'\### Assistant: </turn> ok' AS text
                         FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    out = chat.format_chats(turns).withColumn("formatted", chat.formatted_text(F.col("segments")))
    out = out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("trained", chat.trained_text(F.col("segments")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), sha256_text(said).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), sha256_text(F.col("trained")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("n_bad_turns").cast("long").alias("n_bad_turns"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors, cosine 0.9."""
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated 20-word windows."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256_text(F.col("kept_text")).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      sha256_text(F.array_join("ids", " ")).alias("ids_sha256"),
                      sha256_text(F.col("decoded")).alias("decoded_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document; a tenth of them, by checksum of the id, made periodic."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    docs = docs.withColumn("a", (g % F.when(n > 0, n)).cast("int")).withColumn("rest", n - F.col("a"))
    p = F.lit(1) + F.floor(F.col("rest") / (g % 8 + 3)).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, p), F.ceil(F.col("rest") / p).cast("int")))
    made = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("rest")))
    docs = docs.select("doc_id", F.when(n > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
    out = runs.collapse_runs(docs).withColumn("best", runs.longest_run("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      sha256_text(F.array_join(lines, "")).alias("runs_sha256"), sha256_text(F.col("collapsed")).alias("collapsed_sha256"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter
    replaced by the beginning of the next document, and their likeness."""
    docs = table(spark, sf_dir, "documents")
    rows = fingerprints.fingerprint(docs, {"fingerprint": F.col("text")}, {"doc_id": F.col("doc_id"), "text": F.col("text")})
    rows = fingerprints.with_next(rows, fingerprints.text_ranges(docs), carry=("fingerprint",))
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - moved), F.substr("next_text", F.lit(1), moved))
    keep = {c: F.col(c) for c in ("doc_id", "fingerprint", "next_fingerprint")}
    out = fingerprints.fingerprint(rows, {"edited_fingerprint": edited}, {**keep, "n_chars": n.cast("long"), "edited_sha256": sha256_text(edited)})
    near = lambda other: fingerprints.likeness(F.col("fingerprint"), F.col(other))
    text = lambda c: fingerprints.as_text(F.col(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"),
                      near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and the root that follows from
    its text without line feeds where the id's checksum is even."""
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    altered = merkle.leaf_digest(*[F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in fields])
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = merkle.manifest(docs, fields, carry={"tampered": F.when(even, altered)})
    folded = merkle.fold(F.coalesce("carried.tampered", "leaf"), F.col("steps"), F.col("proof"))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", sha256_text(F.col("proof")).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_neardup, op2_toxicity, op3_token_records, op4_decontamination, op5_sharding, op6_lm_score, op7_chat_format,
    op8_embedding_neardup, op9_substring_dedup, op10_bpe, op11_periodic_runs,
    op12_fingerprints, op13_merkle_manifest)}

#: ASCII lower case and the words of a text, in SQL.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LETTERS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Turn texts and marks as in chat.Template; SQL states the escapes on its own.
_ESC = "replace(replace(replace({0}, '\\', '\\e'), '<', '\\l'), '#', '\\h')"

#: One field of a Merkle leaf; the CRC-32 of a number's decimal text, from the
#: byte table `crc` of the polynomial 0xEDB88320.
_FRAMED = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda x:
    list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS crc)"""
_CRC = """xor(4294967295, list_reduce(list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: xor(a >> 8, crc[(xor(a, c) & 255) + 1]), 4294967295))"""

ORACLE = {
    "op1_minhash_neardup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op4_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_LETTERS.format(_LOWER)} AS w FROM documents),
        b AS (SELECT item_id, {_LETTERS.format(_LOWER)} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
            SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
            SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
        h AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, g)),
        c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_embedding_neardup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    "op9_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
        words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_chat_format": rf"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        f AS (
            SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: '
                WHEN 'assistant' THEN '### Assistant: ' ELSE '### Other: ' || {_ESC.format("role")} || '<|>' END
                || {_ESC.format("text")} || '</turn>' || chr(10) AS framed,
                (coalesce(lag(role) OVER w, '') || '>' || role) NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS bad,
                row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        g AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS trained,
                sum(length(framed)) AS formatted_chars, count(*) FILTER (bad) AS n_bad_turns, arg_max(role, place) = 'assistant' AS ends
            FROM f GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained)::BIGINT AS loss_chars,
            sha256(trained) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
            n_bad_turns = 0 AND ends AS valid, n_bad_turns FROM g""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
        leaf AS (
            SELECT doc_id, source, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS p,
                count(*) OVER (PARTITION BY source) AS n, sha256({" || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS h,
                CASE WHEN {_CRC.format("doc_id")} % 2 = 0 THEN sha256({" || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')"))}) END AS t
            FROM documents, crc),
        low AS (SELECT tree, 0 AS lv, p, n, h FROM leaf UNION ALL
            SELECT tree, lv + 1, p // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY tree, lv, p // 3),
        sub AS (SELECT tree, h, row_number() OVER (ORDER BY CASE WHEN tree = '-' THEN NULL ELSE tree END NULLS FIRST) - 1 AS p, count(*) OVER () AS n, lv AS high
            FROM low WHERE n = 1),
        top AS (SELECT 'top' AS tree, 0 AS lv, p, n, h FROM sub UNION ALL
            SELECT tree, lv + 1, p // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY tree, lv, p // 3),
        path AS (
            SELECT doc_id, x.lv, x.p, x.h FROM leaf l JOIN low x ON x.tree = l.tree AND x.p // 3 = l.p // (3 ** (x.lv + 1))::BIGINT AND x.p <> l.p // (3 ** x.lv)::BIGINT
            UNION ALL SELECT doc_id, 1000 + x.lv, x.p, x.h FROM leaf l JOIN sub s ON s.tree = l.tree
            JOIN top x ON x.p // 3 = s.p // (3 ** (x.lv + 1))::BIGINT AND x.p <> s.p // (3 ** x.lv)::BIGINT),
        proof AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY lv, p)) AS proof FROM path GROUP BY doc_id),
        fold AS (SELECT doc_id, tree, 0 AS lv, p, n, coalesce(t, h) AS h FROM leaf UNION ALL
            SELECT f.doc_id, f.tree, f.lv + 1, f.p // 3, (max(f.n) + 2) // 3, sha256(string_agg(CASE WHEN x.p = f.p THEN f.h ELSE x.h END, '' ORDER BY x.p))
            FROM fold f JOIN low x ON x.tree = f.tree AND x.lv = f.lv AND x.p // 3 = f.p // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.tree, f.lv, f.p // 3),
        fold_top AS (SELECT doc_id, 0 AS lv, s.p, s.n, f.h FROM fold f JOIN sub s ON s.tree = f.tree AND f.n = 1 UNION ALL
            SELECT f.doc_id, f.lv + 1, f.p // 3, (max(f.n) + 2) // 3, sha256(string_agg(CASE WHEN x.p = f.p THEN f.h ELSE x.h END, '' ORDER BY x.p))
            FROM fold_top f JOIN top x ON x.lv = f.lv AND x.p // 3 = f.p // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.lv, f.p // 3)
        SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM leaf l JOIN sub s ON s.tree = l.tree JOIN top r ON r.n = 1 JOIN fold_top f ON f.doc_id = l.doc_id AND f.n = 1 LEFT JOIN proof ON proof.doc_id = l.doc_id""",
}
