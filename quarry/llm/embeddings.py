"""Near-duplicate embeddings by quantised tile products.

Equal vectors are first collapsed. The distinct vectors are dealt into blocks
of bounded size, each around one of at most PIVOTS vectors, and a cell compares
two blocks: int8 codes are multiplied tile by tile, a bound on each vector's
quantisation error tells which pairs may reach the threshold, and only those
that the bounds leave open are computed again in double precision. A cell
returns, for every vector with links, how many there are and one edge to the
least vector of its group in the cell; pairs are never emitted.

Two blocks whose pivots are farther apart than both radii and the threshold's
angle together hold no link: their cell is skipped, exactly. Without such
clusters the work is the n^2 / 2 of a comparison of all rows, in cells of equal,
bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quarry.llm.common import materialize, quoted, ship_package
from quarry.llm.components import connected_components, least_of_group

#: Distinct vectors in a block at most (a cell holds two), and blocks that a
#: small input is dealt into all the same, down to LEAST vectors each.
BLOCK, BLOCKS, LEAST = 8192, 10, 256
#: Most vectors that blocks are formed around.
PIVOTS = 64
#: Rows and columns of a tile, and pairs computed in double precision at once.
TILE = 1024
EXACT_AT_ONCE = 1 << 16
#: Above the rounding error of a double-precision sum of products of unit vectors.
ROUNDING = 1e-12


def _pack(kind: type):
    """Vectors as the bytes of their numbers; NULL if they can link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()  # without the values of NULL vectors
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = flat.is_valid().to_numpy(zero_copy_only=False)
            x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0.0 is 0.0
            ends = np.append(0, np.cumsum(size))
            bad, some = (np.append(0, np.cumsum(c))[ends] for c in (~(whole & np.isfinite(x)), x != 0))
            fit = (np.diff(bad) == 0) & (np.diff(some) > 0)
            offsets = (ends * x.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(size), [pa.array(fit).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["vec_id", "vec"])

    return run


def _unit(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of packed ones of either kind."""
    raw = np.frombuffer(b"".join(vectors), np.float32 if len(vectors[0]) == 4 * dim else float).astype(float).reshape(-1, dim)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


class Codes:
    """Unit vectors of one block with int8 codes and error bounds."""

    def __init__(self, vectors: list[bytes], dim: int):
        self.unit = _unit(vectors, dim)
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.q = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        coded = self.q * self.scale[:, None]
        self.norm = np.sqrt((coded**2).sum(axis=1))
        self.err = np.sqrt(((self.unit - coded) ** 2).sum(axis=1)) + ROUNDING


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes, in floats that hold them exactly."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def linked_pairs(a: Codes, b: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks with cosine at or over the threshold, tile by
    tile; of one block with itself each pair once."""
    for i in range(0, len(a.q), TILE):
        for j in range(i if same else 0, len(b.q), TILE):
            r, c = slice(i, i + TILE), slice(j, j + TILE)
            product = _products(a.q[r], b.q[c])
            # per row, a limit that no pair of the tile that may reach the threshold is under
            slack = b.err[c].max() * a.norm[r] + a.err[r] * b.norm[c].max() + a.err[r] * b.err[c].max()
            least = threshold - slack
            limit = np.where(least > 0, least / (a.scale[r] * b.scale[c].max()), least / (a.scale[r] * b.scale[c].min()))
            x, y = np.nonzero(product >= limit[:, None] - 0.5)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            about = product[x, y].astype(float)
            x, y = x + i, y + j
            about *= a.scale[x] * b.scale[y]
            bound = a.norm[x] * b.err[y] + a.err[x] * b.norm[y] + a.err[x] * b.err[y] + ROUNDING
            sure = about - bound >= threshold
            open_ = np.flatnonzero(~sure & (about + bound >= threshold))
            for k in range(0, len(open_), EXACT_AT_ONCE):
                part = open_[k : k + EXACT_AT_ONCE]
                sure[part] = np.einsum("ij,ij->i", a.unit[x[part]], b.unit[y[part]]) >= threshold
            yield x[sure], y[sure]


def _cell(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = (int(rows[c].iloc[0]) for c in ("dim", "i", "j"))
        left = rows[rows.block == i].sort_values("node", ignore_index=True)
        right = left if i == j else rows[rows.block == j].sort_values("node", ignore_index=True)
        both = left if i == j else pd.concat([left, right], ignore_index=True)
        n, shift = len(both), 0 if i == j else len(left)
        weight, links = both.copies.to_numpy(), np.zeros(n, np.int64)
        label = np.arange(n)
        if len(left) and len(right):
            a = Codes(left.vec.tolist(), dim)
            b = a if i == j else Codes(right.vec.tolist(), dim)
            for x, y in linked_pairs(a, b, threshold, i == j):
                y = y + shift
                links += np.bincount(x, weight[y], n).astype(np.int64) + np.bincount(y, weight[x], n).astype(np.int64)
                label = least_of_group(n, label[x], label[y])[label]
        has = np.flatnonzero(links)
        node = both.node.to_numpy()
        return pd.DataFrame({"node": node[has], "n": links[has], "to": node[label[has]]})

    return run


def _pivots(alike: DataFrame, many: int) -> dict[int, np.ndarray]:
    """Unit vectors that blocks are formed around, by dimension: at most
    ``many`` vectors of the table, chosen by their hash."""
    by_dim: dict[int, list] = {}
    for r in alike.select("node", "vec", "dim").orderBy("node").limit(many).collect() if many > 1 else ():
        by_dim.setdefault(r.dim, []).append(_unit([r.vec], r.dim)[0])
    return {dim: np.array(v) for dim, v in by_dim.items()}


def _around(alike: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each vector with its nearest pivot (number and vector, none if its
    dimension has none) and the angle between them, written."""
    sent = alike.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, angle, centre = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, math.pi), [None] * batch.num_rows
            dims = batch.column(3).to_numpy()
            for dim in set(dims.tolist()) & sent.value.keys():
                at, own = np.flatnonzero(dims == dim), sent.value[dim]
                for lo in range(0, len(at), TILE):
                    some = at[lo : lo + TILE]
                    unit = _unit([batch.column(1)[k].as_py() for k in some.tolist()], dim)
                    cosine = unit @ own.T
                    near[some] = cosine.argmax(axis=1)
                    # of small angles the cosine says little: the chord does
                    chord = unit - own[near[some]]
                    angle[some] = 2 * np.arcsin(np.minimum(1.0, np.sqrt(np.einsum("ij,ij->i", chord, chord)) / 2))
                    for k in some.tolist():
                        centre[k] = own[near[k]].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(angle), pa.array(centre, pa.binary())],
                                             names=[*batch.schema.names, "pivot", "angle", "centre"])

    return materialize(alike.select("node", "vec", "copies", "dim").mapInArrow(
        run, "node binary, vec binary, copies long, dim int, pivot int, angle double, centre binary"), "around")


#: Above the rounding error of an angle.
_ANGLE = 1e-7


def may_link(centres: np.ndarray, radius: np.ndarray, threshold: float) -> np.ndarray:
    """For every two pivots whether vectors within their radii can reach the
    threshold, by the triangle inequality of angles."""
    chord = centres[:, None, :] - centres[None, :, :]
    apart = 2 * np.arcsin(np.minimum(1.0, np.sqrt((chord**2).sum(axis=2)) / 2))
    return apart <= radius[:, None] + radius[None, :] + math.acos(threshold) + _ANGLE


def _layout(threshold: float, block: int):
    """Blocks of the pivots of one dimension, and those that each must meet."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pivot", ignore_index=True)
        blocks = np.ceil(rows.n.to_numpy() / block).astype(np.int32)
        first = np.cumsum(blocks) - blocks
        if rows.centre.isna().any():  # one part without a pivot
            meets = np.ones((len(rows), len(rows)), bool)
        else:
            meets = may_link(np.array([np.frombuffer(c, float) for c in rows.centre]), rows.radius.to_numpy(), threshold)
        others = [np.concatenate([np.arange(first[q], first[q] + blocks[q]) for q in np.flatnonzero(m)]).tolist() for m in meets]
        return pd.DataFrame({"dim": rows["dim"], "pivot": rows["pivot"], "first": first.astype(np.int32), "blocks": blocks, "others": others})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                           vec_col: str = "embedding", block: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """Per vector ``vec_id``, ``n_links`` (other rows with cosine at or over
    ``threshold``), ``component_id`` (least vec_id reachable by links) and
    ``kept``.

    NULL, empty and zero vectors, and vectors with a NULL or non-finite
    component, link with nothing and are kept, also where they repeat; vectors
    of different lengths don't link. Equal vectors of several rows link with
    one another and share their links. A NULL vec_id counts as a row but never
    as a component's least id. No rows give no rows. Other columns do not matter,
    whatever their name. ``block`` is the size of a block (default: by the
    number of vectors, at most ``BLOCK``).
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    ship_package(vectors.sparkSession)
    single = isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)
    width, kind = (4, "array<float>") if single else (8, "array<double>")
    packed = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vec_col)).cast(kind).alias("v")) \
        .mapInArrow(_pack(np.float32 if single else np.float64), "vec_id long, vec binary").withColumn("node", F.unhex(F.md5("vec")))
    alike = materialize(packed.where("vec IS NOT NULL").groupBy("node").agg(
        F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "vectors")
    alike = alike.withColumn("dim", (F.octet_length("vec") / width).cast("int"))
    n = alike.count()
    block = block or min(BLOCK, max(LEAST, math.ceil(n / BLOCKS)))
    near = _around(alike, _pivots(alike, min(pivots, n // (2 * block))))
    layout = near.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.first("centre").alias("centre")) \
        .groupBy("dim").applyInPandas(_layout(threshold, block), "dim int, pivot int, first int, blocks int, others array<int>")
    dealt = near.join(materialize(layout, "layout"), ["dim", "pivot"])
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.select("node", "vec", "copies", "dim", "block", F.explode("others").alias("other")) \
        .select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = materialize(cells.groupBy("dim", "i", "j").applyInPandas(_cell(threshold), "node binary, n long, `to` binary"), "links")
    degree = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    class_of = alike.select("node", "least", "copies").join(groups, "node", "left").join(degree, "node", "left") \
        .select("node", "least", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    class_of = materialize(class_of, "classes")
    # written first, so that Spark can split the join where a class is very large
    least = materialize(class_of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = class_of.join(least, "root").select("node", "component_id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    out = packed.select("vec_id", "node").join(of, "node", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
