"""Fixed-window text chunking (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import constants as K


def chunk_text(df: DataFrame, text_col: str = "content", keep: list[str] | None = None,
               size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """One row per window of ``size`` code points starting every ``size - overlap``.

    Windows start while ``start < length``, so the last one may lie wholly
    inside the previous one; empty text yields no rows. Output columns:
    ``keep..., chunk_index int, text string``. A narrow ``posexplode``: no
    shuffle, rows stay in the partition of their file.
    """
    step = size - overlap
    if size <= 0 or step <= 0:
        raise ValueError("chunk size must exceed overlap")
    keep = list(keep or [])
    text = F.col(text_col)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))) \
        .otherwise(F.array().cast("array<int>"))
    exploded = df.select(*keep, text.alias("_t"), F.posexplode(starts).alias("chunk_index", "_s"))
    return exploded.select(
        *keep,
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("_t").substr(F.col("_s") + 1, F.lit(size)).alias("text"),
    )
