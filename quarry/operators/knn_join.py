"""Exact k-nearest-neighbour join of two distributed sides (J1, J1 per root).

Queries and corpus vectors meet in cells; neither side passes the driver, so
both can be of any size, and a group (a root) is searched within itself only.

1. A group of more than ``CELL_ROWS`` vectors is parted by pivots: up to
   ``MOST_PIVOTS`` vectors of the corpus, of which a group uses as many as it
   has cells. Every vector goes to its nearest pivot. Per (group, pivot) the
   least and greatest distance to the pivot and the k least are kept.
2. A vector is at most d(query, pivot) + d(pivot, vector) away. So the k-th
   least of these sums over the kept distances bounds the query's k-th
   neighbour, and by the triangle inequality a pivot whose ring, or whose side
   of the plane between it and the query's own pivot, is farther away than that
   can hold no neighbour. The query skips it.
3. Equal questions of a group are asked once. A part of more than ``CELL_ROWS`` vectors, and the queries that visit a part,
   are dealt by hash into blocks; each pair of blocks is one cell, a task of
   bounded size. A cell screens 1,024 queries at a time, so ``QUERY_ROWS`` costs
   no memory but its vectors. Cells return their k best; these are merged per
   query, and equal questions get their answers.

Distances are those of ``knn``, bit by bit, and so is the order of ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.knn import merge_top_k, top_k_blocks
from quarry.sinks.tables import write_snapshot

CELL_ROWS = 8192
QUERY_ROWS = 16384  # the larger, the fewer copies of the corpus vectors are shuffled; cells screen QUERY_BLOCK at a time
MOST_PIVOTS = 64
_SLACK = 1e-9  # relative; covers the rounding of distances


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(vectors), len(pivots)))
    for j, p in enumerate(pivots):
        d = vectors - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def choose_pivots(corpus: DataFrame, keys: list[str], n: int, many: int) -> np.ndarray:
    """``many`` vectors of the corpus, spread by a hash of their keys; at most
    ``MOST_PIVOTS`` rows are collected."""
    h = F.xxhash64(*keys)
    some = corpus.where(F.pmod(h, F.lit(max(1, n // (8 * many)))) == 0)
    rows = some.where("_v IS NOT NULL").select("_v", h.alias("h")).orderBy("h").limit(many).collect()
    return np.array(list(dict.fromkeys(tuple(r["_v"]) for r in rows)), np.float64)


def assign(corpus: DataFrame, sizes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The corpus with the nearest ``pivot`` of its group's and the ``dist`` to
    it, written."""
    src = corpus.where("_v IS NOT NULL").join(sizes.select("_g", "parts"), "_g")
    schema = T.StructType([f for f in src.schema.fields if f.name != "parts"] + T.StructType.fromDDL("pivot int, dist double").fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                d = _distances(_matrix(part["_v"]), pivots)
                d[np.arange(len(pivots))[None, :] >= part["parts"].to_numpy()[:, None]] = np.inf
                near = d.argmin(axis=1)
                yield part.drop(columns="parts").assign(pivot=near.astype(np.int32), dist=d[np.arange(len(part)), near])

    return write_snapshot(src.mapInPandas(run, schema), "knn-corpus")


def rings(assigned: DataFrame, k: int) -> DataFrame:
    """Per group the arrays, over its pivots, of ``pivot``, ``lo``, ``hi`` and
    the ``k`` least distances (``near``, k for each pivot, infinite where there
    are fewer)."""
    nearest = Window.partitionBy("_g", "pivot").orderBy("dist")
    least = assigned.select("_g", "pivot", "dist").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k) \
        .groupBy("_g", "pivot").agg(F.array_sort(F.collect_list("dist")).alias("near"))
    size = assigned.groupBy("_g", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    full = F.slice(F.concat("near", F.array_repeat(F.lit(float("inf")), k)), 1, k)
    parts = size.join(least.select("_g", "pivot", full.alias("near")), ["_g", "pivot"])
    by = parts.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("pivot", "lo", "hi", "near"))).alias("p"))
    return by.select("_g", *[F.col(f"p.{c}").alias(c) for c in ("pivot", "lo", "hi")], F.flatten("p.near").alias("near"))


def visited(q: np.ndarray, pivots: np.ndarray, between: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which of the pivots each query must visit; ``between`` has the distances
    of the pivots, ``near`` a row of least distances for each."""
    d = _distances(q, pivots)
    bound = np.sort((d[:, :, None] + near[None, :, :]).reshape(len(q), -1), axis=1)[:, near.shape[1] - 1]
    away = np.maximum(np.maximum(d - hi, lo - d), 0.0)
    own = d.argmin(axis=1)
    gap = between[own]  # of each pivot to the query's own
    scale = 1.0 + d.max(axis=1, keepdims=True)
    apart = np.where(gap > 1e-3 * scale, gap, np.inf)  # of pivots close together the plane is not sure enough
    plane = (d**2 - d[np.arange(len(q)), own][:, None] ** 2) / (2 * apart)
    slack = _SLACK * scale
    return np.maximum(away, plane) <= bound[:, None] + slack


def query_visits(queries: DataFrame, ring: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The queries with ``visits``, the pivots whose parts can hold one of their
    neighbours, written. Queries of a group without vectors are left out."""
    between = _distances(pivots, pivots)
    src = queries.join(ring, "_g")
    fields = [f for f in queries.schema.fields] + [T.StructField("visits", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, group in pdf.groupby("_g", sort=False):
                first = group.iloc[0]
                own = np.asarray(first["pivot"], np.int64)
                near = np.asarray(first["near"], np.float64).reshape(len(own), -1)
                for lo in range(0, len(group), 256):
                    part = group.iloc[lo : lo + 256]
                    must = visited(_matrix(part["_q"]), pivots[own], between[np.ix_(own, own)], np.asarray(first["lo"]), np.asarray(first["hi"]), near)
                    yield part[[f.name for f in fields[:-1]]].assign(visits=[own[m].tolist() for m in must])

    return write_snapshot(src.mapInPandas(run, T.StructType(fields)), "knn-queries")


def _dealt(rows: DataFrame, cells: DataFrame, own: str, key: list[str], other: str, own_block: str, other_block: str) -> DataFrame:
    """Rows with their block by hash, once for each block of the other side."""
    out = rows.join(cells.select("_g", "pivot", own, other), ["_g", "pivot"])
    return out.withColumn(own_block, F.pmod(F.xxhash64(*key), F.col(own)).cast("int")) \
        .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)


def knn_join(corpus: DataFrame, queries: DataFrame, k: int, keys: list[str], vec_col: str = "embedding",
             query_key: str = "query_id", query_vec: str = "embedding", corpus_group: Column | None = None,
             query_group: Column | None = None, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Top-k corpus rows per query: ``query_id, keys..., distance, rank``.

    With ``corpus_group`` and ``query_group`` only rows of the query's own group
    count; NULL groups match nothing. NULL vectors match nothing. Ties are
    broken by the keys. Fewer than k rows give all of them, no rows none. Query
    ids must be unique.
    """
    spark = corpus.sparkSession
    qtype = queries.schema[query_key].dataType
    one = F.lit(0)
    c = corpus.select((one if corpus_group is None else corpus_group).alias("_g"), *keys, F.col(vec_col).alias("_v"))
    q = queries.select((one if query_group is None else query_group).alias("_g"), F.col(query_key).alias("query_id"), F.col(query_vec).alias("_q")) \
        .where("_q IS NOT NULL")
    who = write_snapshot(q, "knn-queries")  # embedded once, whoever reads it
    # equal questions of a group have equal answers: the one with the least id is asked for all of them
    q = write_snapshot(who.groupBy("_g", "_q").agg(F.min("query_id").alias("query_id")).select("_g", "query_id", "_q"), "knn-asked")
    who = who.join(q.withColumnsRenamed({"_g": "_h", "query_id": "_asked", "_q": "_r"}), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_q") == F.col("_r")))
    cand_schema = T.StructType([T.StructField("query_id", qtype)] + [corpus.schema[x] for x in keys] + [T.StructField("distance", T.DoubleType())])
    if k <= 0:
        return merge_top_k(spark.createDataFrame([], cand_schema), keys, 0)
    sizes = write_snapshot(c.groupBy("_g").agg(F.count(F.lit(1)).alias("n")), "knn-sizes")
    most, total = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    many = min(MOST_PIVOTS, -(-most // cell_rows))
    pivots = choose_pivots(c, keys, total, many) if many > 1 else ()
    if len(pivots) > 1:
        sizes = sizes.withColumn("parts", F.least(F.ceil(F.col("n") / cell_rows), F.lit(len(pivots))).cast("int"))
        c = assign(c, sizes, pivots)
        q = query_visits(q, rings(c, k), pivots)
        n_rows = c.groupBy("_g", "pivot").agg(F.count(F.lit(1)).alias("n"))
    else:  # every group is one part
        c, q = c.where("_v IS NOT NULL").withColumn("pivot", one), q.withColumn("visits", F.array(one))
        n_rows = sizes.select("_g", one.alias("pivot"), "n")
    calls = q.select("_g", F.explode("visits").alias("pivot"))
    cells = n_rows.join(calls.groupBy("_g", "pivot").agg(F.count(F.lit(1)).alias("m")), ["_g", "pivot"]).select(
        "_g", "pivot", F.ceil(F.col("n") / cell_rows).cast("int").alias("nc"), F.ceil(F.col("m") / query_rows).cast("int").alias("nq"))
    cells = write_snapshot(cells, "knn-cells")
    right = _dealt(c.select("_g", "pivot", *keys, "_v"), cells, "nc", keys, "nq", "bc", "bq")
    left = _dealt(q.select("_g", F.explode("visits").alias("pivot"), "query_id", "_q"), cells, "nq", ["query_id"], "nc", "bq", "bc")
    names = cand_schema.names

    def cell(near: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if near.empty or there.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        mat = np.stack(near["_q"].to_numpy())
        found = [b[names] for b in top_k_blocks(near["query_id"].to_numpy(), mat, k, keys, "_v", iter([there]))]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({n: pd.Series(dtype=object) for n in names})

    by = ["_g", "pivot", "bc", "bq"]
    # a stated number of partitions: cells take long for their bytes, and Spark would join small ones to few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInPandas(cell, cand_schema)
    best = merge_top_k(found, keys, k).withColumnRenamed("query_id", "_asked")
    return who.select("query_id", "_asked").join(best, "_asked").select("query_id", *keys, "distance", "rank")
