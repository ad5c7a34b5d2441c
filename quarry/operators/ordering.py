"""Ordering operators (W5) and ordered concatenation in windows.

``ordered_rank`` numbers rows in a total order without a single-partition
window: range-partition + local sort, per-partition counts turned into
offsets (one row per partition), then ``offset + position``. The sorted data
is checkpointed first so range boundaries and positions are fixed even if a
task is retried.

``ordered_windows`` joins the texts of a group in order and returns the whole
of it, cut into windows of a stated number of characters. Only keys and
lengths are range-partitioned; character offsets follow from sums per range
and group, as the ranks do. The texts are then joined to their offsets, cut at
window borders, and gathered by (group, window): no task holds more than one
window of a group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

_POS_BITS = 33


def ordered_rank(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """1-based rank within ``group_cols`` by ``order_cols`` (a total order)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    # as many ranges as the input has splits (at least the shuffle default), so
    # a range holds about one input split of rows whatever the data size
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    staged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint())
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _POS_BITS)
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    ranked = staged.join(F.broadcast(offsets), "_pid").withColumn("_g", F.col("_off") + pos + 1)
    if not group_cols:
        return ranked.withColumn(name, F.col("_g")).drop("_pid", "_mid", "_off", "_g")
    # one row per group; AQE broadcasts it at run time when it is small
    starts = ranked.groupBy(*group_cols).agg(F.min("_g").alias("_g0"))
    return (ranked.join(starts, group_cols)
            .withColumn(name, F.col("_g") - F.col("_g0") + 1)
            .drop("_pid", "_mid", "_off", "_g", "_g0"))


def char_offsets(keys: DataFrame, group_cols: list[str]) -> DataFrame:
    """``start`` of each row's text in its group's joined text, with the
    group's ``n_rows`` and ``all_chars``, for rows ``(group..., _o, _len)``.
    ``_o`` is a total order within the group."""
    checkpoint_dir(keys.sparkSession)
    staged = (keys.repartitionByRange(*group_cols, "_o").sortWithinPartitions(*group_cols, "_o")
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    here = Window.partitionBy("_pid", *group_cols).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*group_cols)
    sums = staged.groupBy("_pid", *group_cols).agg(F.sum("_len").alias("_s"), F.count(F.lit(1)).alias("_c"))
    sums = sums.select("_pid", *group_cols,
                       F.coalesce(F.sum("_s").over(ranges.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                       F.sum("_s").over(ranges).alias("all_chars"), F.sum("_c").over(ranges).alias("n_rows"))
    rows = staged.withColumn("_before", F.coalesce(F.sum("_len").over(here), F.lit(0)))
    return rows.join(sums, ["_pid", *group_cols]).select(
        *group_cols, "_o", (F.col("_base") + F.col("_before")).alias("start"), "n_rows", "all_chars")


def ordered_windows(df: DataFrame, group_cols: list[str], order_col: Column, piece: Column, sep: str,
                    limit: int | DataFrame) -> DataFrame:
    """Per group and ``window`` (from 0): ``text``, ``n_windows``, ``n_rows``
    and ``total_chars`` of the whole joined text. The windows' texts in a row
    are the joined text. ``limit`` is the characters of a window, or a frame
    ``(group..., limit)`` with one row per group."""
    pieces = df.select(*group_cols, order_col.alias("_o"), piece.alias("_p"))
    offsets = char_offsets(pieces.select(*group_cols, "_o", (F.length("_p") + len(sep)).alias("_len")), group_cols)
    rows = pieces.join(offsets, [*group_cols, "_o"])
    rows = rows.withColumn("limit", F.lit(limit)) if isinstance(limit, int) else rows.join(limit.select(*group_cols, "limit"), group_cols)
    total = F.col("all_chars") - len(sep)
    last = F.col("start") + F.length("_p") == total
    rows = rows.withColumn("_p", F.when(last, F.col("_p")).otherwise(F.concat("_p", F.lit(sep)))).where(F.length("_p") > 0)
    first_w = F.floor(F.col("start") / F.col("limit"))
    last_w = F.floor((F.col("start") + F.length("_p") - 1) / F.col("limit"))
    rows = rows.withColumn("window", F.explode(F.sequence(first_w, last_w)))
    begin = F.greatest(F.col("window") * F.col("limit") - F.col("start"), F.lit(0))
    end = (F.col("window") + 1) * F.col("limit") - F.col("start")
    part = F.substr("_p", (begin + 1).cast("int"), (end - begin).cast("int"))
    cut = rows.select(*group_cols, "window", "start", part.alias("_t"), "n_rows", total.alias("total_chars"), "limit")
    return cut.groupBy(*group_cols, "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "_t"))), lambda s: s["_t"]), "").alias("text"),
        F.max(F.ceil(F.col("total_chars") / F.col("limit"))).alias("n_windows"),
        F.max("n_rows").alias("n_rows"), F.max("total_chars").alias("total_chars"))
