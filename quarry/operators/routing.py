"""Model routing and catalog checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import constants as K


def routes(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """Routing table ``(purpose, model, num_ctx, num_predict)``; ``''`` model
    means the default model. ``overrides`` maps purpose -> model name."""
    rows = [(p, (overrides or {}).get(p, m), c, n) for p, m, c, n in K.ROUTES]
    return spark.createDataFrame(rows, "purpose string, model string, num_ctx int, num_predict int")


def route_model(requests: DataFrame, route_table: DataFrame, default_model: str = K.DEFAULT_MODEL,
                purpose_col: str = "purpose") -> DataFrame:
    """Model (blank -> default), context size and output cap per request;
    an unknown purpose gets the defaults. The route table is a handful of rows."""
    r = F.broadcast(route_table.withColumnRenamed("purpose", "_p"))
    j = requests.join(r, requests[purpose_col] == r["_p"], "left").drop("_p")
    return j.withColumn("model", F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(default_model))) \
        .withColumn("num_ctx", F.coalesce("num_ctx", F.lit(K.DEFAULT_NUM_CTX))) \
        .withColumn("num_predict", F.coalesce("num_predict", F.lit(K.DEFAULT_NUM_PREDICT)))


def model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Installed models from a JSON document ``{"models": [{name, size,
    modified_at}, ...]}``; an empty list is an empty frame, not a failure."""
    schema = "models array<struct<name: string, size: bigint, modified_at: string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    m = raw.select(F.explode_outer("models").alias("m")).where(F.col("m").isNotNull())
    return m.select(F.col("m.name").cast("string").alias("name"),
                    F.col("m.size").cast("bigint").alias("size"),
                    F.col("m.modified_at").cast("string").alias("modified_at"))


def model_facts(catalog: DataFrame) -> DataFrame:
    """Size in GB with 2 decimals (``?`` when 0), date = first 10
    characters, base name = part before ``:`` lower-cased."""
    size = F.when(F.coalesce(F.col("size"), F.lit(0)) != 0,
                  F.concat(F.format_string("%.2f", F.col("size") / F.lit(1e9)), F.lit(" GB"))) \
        .otherwise(F.lit("?"))
    return catalog.select(
        F.coalesce("name", F.lit("?")).alias("name"), size.alias("size_text"),
        F.substring(F.coalesce("modified_at", F.lit("")), 1, 10).alias("modified"),
        F.lower(F.split_part(F.coalesce("name", F.lit("?")), F.lit(":"), F.lit(1))).alias("base_name"))


def configured_models(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """The checked purposes (default, fast, coding, review) and their models."""
    rt = {p: m for p, m, _, _ in K.ROUTES}
    rows = []
    for pos, p in enumerate(K.CHECKED_PURPOSES):
        m = (overrides or {}).get(p, rt.get(p, ""))
        rows.append((pos, p, m or (overrides or {}).get("default", K.DEFAULT_MODEL)))
    return spark.createDataFrame(rows, "pos int, purpose string, model string")


def missing_models(configured: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per configured purpose, the first installed model with the same base
    name (catalog order), or NULL when missing; plus ``all_ok``."""
    facts = model_facts(catalog).withColumn("_i", F.monotonically_increasing_id())
    c = configured.withColumn("base_name", F.lower(F.split_part("model", F.lit(":"), F.lit(1))))
    j = c.join(facts.select("base_name", F.col("name").alias("found_as"), "_i"), "base_name", "left")
    first = j.groupBy("pos", "purpose", "model").agg(F.min_by("found_as", "_i").alias("found_as"))
    w = Window.partitionBy()
    return first.withColumn("all_ok", F.min(F.col("found_as").isNotNull().cast("int")).over(w) == 1)
