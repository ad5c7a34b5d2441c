"""Exact k-nearest-neighbour search.

Squared L2 distance of every query to every corpus vector, lower is better,
ties broken by the corpus key. Plan:

1. A query side of up to ``MOST_QUERIES`` rows and ``BROADCAST_BYTES`` (checked
   by a bounded ``limit`` collect) is broadcast as float32, so the corpus is
   scanned once and not shuffled. A larger one goes to ``knn_join``, where
   neither side passes the driver. The corpus is never broadcast or collected.
   Inside a task the queries are screened ``QUERY_BLOCK`` at a time.
2. Per corpus partition (``mapInPandas``, Arrow batches), one BLAS product
   screens candidates: the usual ``|q|^2 + |c|^2 - 2 q.c`` form, with a
   tolerance that covers its rounding. Only the candidates get the exact
   distance, summed dimension by dimension in index order, so the value is
   bit-identical to ``aggregate(zip_with(...))`` in SQL.
3. Each task emits its own top-k per query. The global top-k is taken in two
   levels, per (query, slice of the keys) and then per query, so no task gets
   the ``k x tasks`` rows of one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 1024
BROADCAST_BYTES = 64 << 20  # query vectors broadcast at most
MOST_QUERIES = 4096
SLICE_ROWS = 4096  # corpus rows screened at once at most
SCREENED = 1 << 20  # distances screened at once: fewer corpus rows where there are many queries
PAIRS = 8192  # candidate pairs whose exact distance is taken at once, however many tie
MERGE_SLICES = 32  # slices of the corpus keys in the first level of the top-k
_TOL = 1e-9


def _exact(qv: np.ndarray, cv: np.ndarray) -> np.ndarray:
    """Row-wise sum over dimensions, in dimension order, of (q - c)^2."""
    acc = np.zeros(qv.shape[0], dtype=np.float64)
    for j in range(qv.shape[1]):
        d = qv[:, j] - cv[:, j]
        acc += d * d
    return acc


def candidates(qmat: np.ndarray, k: int, keys: list[str], vec_col: str, pdf: pd.DataFrame,
               reach: np.ndarray | None = None) -> pd.DataFrame:
    """Candidates of one corpus slice (``_q``, the query's row; distance; keys):
    BLAS screen, then exact distances, a bounded number of pairs at a time.
    ``reach``, if given, is each query's k-th least distance so far (infinite
    where it has fewer): nothing beyond it is a candidate."""
    qn = (qmat * qmat).sum(axis=1)
    cmat = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
    if cmat.shape[1] != qmat.shape[1]:
        raise ValueError("query and corpus vectors differ in dimension")
    cn = (cmat * cmat).sum(axis=1)
    approx = qmat @ cmat.T
    approx *= -2.0
    approx += qn[:, None]
    approx += cn[None, :]
    kk = min(k, cmat.shape[0])
    if reach is None or np.isinf(reach).any():
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        if reach is not None:
            kth = np.minimum(kth, reach)
    else:
        kth = reach
    tol = _TOL * (1.0 + qn.max() + cn.max())
    qi, ci = np.nonzero(approx <= (kth + tol)[:, None])
    del approx
    dist = np.empty(len(qi))
    for lo in range(0, len(qi), PAIRS):
        part = slice(lo, lo + PAIRS)
        dist[part] = _exact(qmat[qi[part]], cmat[ci[part]])
    cand = pd.DataFrame({"_q": qi, "distance": dist})
    for key in keys:
        cand[key] = pdf[key].to_numpy()[ci]
    return cand


class Nearest:
    """The running top-k of a block of queries (at most ``QUERY_BLOCK``) over
    the corpus slices that it is shown: at most ``k`` rows per query are kept
    between slices."""

    def __init__(self, qmat: np.ndarray, k: int, keys: list[str], vec_col: str):
        self.qmat, self.k, self.keys, self.vec_col = qmat, k, keys, vec_col
        self.best: pd.DataFrame | None = None
        self.reach = np.full(len(qmat), np.inf)

    def add(self, pdf: pd.DataFrame) -> None:
        found = candidates(self.qmat.astype(np.float64), self.k, self.keys, self.vec_col, pdf, self.reach)
        if found.empty:
            return
        if self.best is not None:
            found = pd.concat([self.best, found], ignore_index=True)
        found = found.sort_values(["_q", "distance", *self.keys], kind="mergesort")
        self.best = found.groupby("_q", sort=False).head(self.k)
        q, d = self.best["_q"].to_numpy(), self.best["distance"].to_numpy()
        n = np.bincount(q, minlength=len(self.reach))
        full = np.nonzero(n == self.k)[0]
        self.reach[full] = d[np.cumsum(n)[full] - 1]  # the last of each query's rows, which are sorted


def top_k_blocks(qids: np.ndarray, qmat: np.ndarray, k: int, keys: list[str], vec_col: str,
                 batches: Iterator[pd.DataFrame], screen_block: int = QUERY_BLOCK) -> Iterator[pd.DataFrame]:
    """The top-k per query (``query_id, distance, keys...``) over all batches."""
    starts = range(0, len(qmat), screen_block)
    blocks = [Nearest(qmat[q0:q0 + screen_block], k, keys, vec_col) for q0 in starts]
    rows = max(1, min(SLICE_ROWS, SCREENED // max(1, min(len(qmat), screen_block))))
    for batch in batches:
        for lo in range(0, len(batch), rows):
            for block in blocks:
                block.add(batch.iloc[lo:lo + rows])
    for q0, block in zip(starts, blocks):
        if block.best is not None:
            out = block.best.drop(columns=["_q"])
            out.insert(0, "query_id", qids[q0 + block.best["_q"].to_numpy()])
            yield out


def merge_top_k(cand: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best candidates of each query with their ``rank``, in two
    levels: per (query, slice of the keys), then per query."""
    salted = cand.withColumn("_s", F.pmod(F.xxhash64(*keys), F.lit(MERGE_SLICES)))
    first = Window.partitionBy("query_id", "_s").orderBy("distance", *keys)
    cand = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_s", "_r")
    w = Window.partitionBy("query_id").orderBy("distance", *keys)
    return cand.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def knn(corpus: DataFrame, queries: DataFrame, k: int, keys: list[str],
        vec_col: str = "embedding", query_key: str = "query_id",
        query_vec: str = "embedding", query_block: int | None = None,
        screen_block: int = QUERY_BLOCK) -> DataFrame:
    """Top-k corpus rows per query: ``query_id, keys..., distance, rank``.

    ``k <= 0`` gives no rows; fewer than k corpus rows gives all of them. NULL
    vectors match nothing. ``query_block`` is the number of queries up to which
    the query side is broadcast (default ``MOST_QUERIES``).
    """
    from quarry.operators.knn_join import knn_join

    spark = corpus.sparkSession
    key_fields = [corpus.schema[c] for c in keys]
    qtype = queries.schema[query_key].dataType
    out_schema = T.StructType(
        [T.StructField("query_id", qtype)]
        + [T.StructField(f.name, f.dataType) for f in key_fields]
        + [T.StructField("distance", T.DoubleType())]
    )
    if k <= 0:
        return merge_top_k(spark.createDataFrame([], out_schema), keys, k)

    most = query_block or MOST_QUERIES
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vec).alias("_v")).where("_v IS NOT NULL")
    rows = q.limit(most + 1).collect()
    if not rows:
        return merge_top_k(spark.createDataFrame([], out_schema), keys, k)
    if len(rows) > most or len(rows) * len(rows[0]["_v"]) * 4 > BROADCAST_BYTES:
        return knn_join(corpus, queries, k, keys, vec_col, query_key, query_vec)
    bc = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], dtype=object),
                                       np.stack([np.asarray(r["_v"], dtype=np.float32) for r in rows])))

    def run(batches):
        ids, mat = bc.value
        yield from top_k_blocks(ids, mat, k, keys, vec_col, batches, screen_block)

    corpus_in = corpus.select(*keys, vec_col).where(F.col(vec_col).isNotNull())
    return merge_top_k(corpus_in.mapInPandas(run, out_schema), keys, k)


def sql_distance(a: str, b: str) -> str:
    """The same distance as a Spark SQL expression (for small inputs and tests)."""
    return (f"aggregate(zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * "
            f"(double(x) - double(y))), 0D, (acc, v) -> acc + v)")
