"""Training-data pipeline over ``documents``: toxic documents go, one of each
group of near copies stays, repeated passages are cut, documents with benchmark
passages go, and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and
returns them; the last returns token ids. Stages work on all rows that the
stage before kept. NULL and empty texts, repeated rows, NULL ids and empty
tables pass through as the operators state; a NULL text leaves the third stage
as an empty one. Further columns of ``docs`` stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import bpe, decontamination, neardup, substrings, toxicity
from quarry.llm.common import forget, materialize, quoted, sha256_text, table

#: Scores from here on reject a document.
TOXIC = 0.5
#: Near copies: words of a shingle and least similarity in percent.
SHINGLE_WORDS, SIMILAR = 5, 80
#: Passages cut when they occurred before, and benchmark windows, in words.
REPEATED_WORDS, BENCHMARK_WORDS = 20, 13


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def _kept(name: str) -> Column:
    return F.col(f"kept.{quoted(name)}")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns))
    return scored.where(F.col("score") < TOXIC).select("kept.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id, of its rows
    the one of the least text hash. Texts without words are no copies."""
    found = neardup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR)
    stay = found.where("head").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("h_"), F.col("n_shingles").alias("n_")).distinct()
    row = F.struct(*map(quoted, docs.columns)).alias("row_")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h_"))
    rows = rows.join(stay.withColumnsRenamed({"id_": "i", "h_": "h"}), F.col("id_").eqNullSafe(F.col("i")) & (F.col("h_") == F.col("h")))
    equal = Window.partitionBy("id_", "h_").orderBy("h_")
    return rows.withColumn("k_", F.row_number().over(equal)).where("k_ = 1 OR n_ = 0").select("row_.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occurred before. A text that loses
    nothing stays as it is, white space included."""
    out = substrings.remove_repeats(docs, REPEATED_WORDS, keep=_others(docs))
    cut = F.col("n_removed") > 0
    made = {"doc_id": F.col("doc_id"), "text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("kept.n_chars"))
    return out.select(*[made.get(c, _kept(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    out = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS, keep=_others(docs), matches=False)
    clean = ~decontamination.contaminated(F.col("n_words"), decontamination.n_hit(F.col("spans")))
    return out.where(clean).select(*[(F.col(c) if c in ("doc_id", "text") else _kept(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the digest of the decoded text."""
    import public_tokenizers

    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", sha256_text(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A model and a tokenizer are in the first and the last stage: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
