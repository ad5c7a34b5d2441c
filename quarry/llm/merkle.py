"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf. The leaves of a group (a source), in order, are hashed in
runs of three, level by level, to the group's subroot; the subroots, in the
order of their groups, are hashed to the root in the same way.

A node's label is (last leaf below it, level), so every child comes before its
parent. The forward sweep reads nodes in the order of their labels and sends
each digest to the parent through a priority queue ordered by label: when the
queue's head is due, all children have arrived. The reversed sweep visits the
labels from the root down and sends to each child the end of its proof, the
siblings from its own level up to the root, until it arrives at the leaves.

The queue is external. Leaves are cut into aligned blocks of ``BLOCK``; what
passes between nodes of one block goes through a heap in the task, and what
leaves a block is a row of a written table, which Spark's shuffle delivers to
the block of the parent. So the largest source is spread over all tasks, a task
holds one block at a time, and a sweep takes log(n) / log(BLOCK) rounds.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import forget, materialize, ship_package

#: Children of a node; leaves of a block, a power of it.
WIDTH = 3
BLOCK = WIDTH**6


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields in a row: ``-`` for NULL, else the
    number of UTF-8 bytes, ``:`` and the value as text."""
    texts = [f.cast("string") for f in fields]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def _hash(kids: list[str]) -> str:
    return hashlib.sha256("".join(kids).encode()).hexdigest()


def _height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // WIDTH), h + 1
    return h


def _last(place: int, level: int, count: int) -> int:
    return min((place + 1) * WIDTH**level, count) - 1


def forward(digests: list[str], height: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The digest ``height`` levels above the leaves of a block, and its inner
    nodes (level, place, digests of the children) in the order of labels."""
    queue: list[tuple[int, int, int, str]] = []  # last leaf and level of the receiver, place of the sender, digest
    nodes, count, top = [], len(digests), digests[0]

    def send(level: int, place: int, digest: str) -> None:
        heapq.heappush(queue, (_last(place // WIDTH, level + 1, count), level + 1, place, digest))

    for i, digest in enumerate(digests if height else ()):
        send(0, i, digest)
        while queue and queue[0][0] <= i:
            last, level, first, _ = queue[0]
            kids = []
            while queue and queue[0][:2] == (last, level):
                kids.append(heapq.heappop(queue)[3])
            nodes.append((level, first // WIDTH, kids))
            top = _hash(kids)
            if level < height:
                send(level, first // WIDTH, top)
    return top, nodes


def backward(nodes: list[tuple[int, int, list[str]]], count: int, steps: str, proof: str) -> list[tuple[str, str]]:
    """For each leaf of a block the steps and the proof, given those of its top."""
    if not nodes:
        return [(steps, proof)] * count
    out: list[tuple[str, str]] = [("", "")] * count
    level, place, _ = nodes[-1]
    queue = [(-_last(place, level, count), -level, steps, proof)]
    for level, place, kids in reversed(nodes):
        _, _, steps, proof = heapq.heappop(queue)
        for j in range(len(kids)):
            child = place * WIDTH + j
            ends = f"{len(kids)}{j}{steps}", "".join(kids[:j] + kids[j + 1 :]) + proof
            if level == 1:
                out[child] = ends
            else:
                heapq.heappush(queue, (-_last(child, level - 1, count), 1 - level, *ends))
    return out


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by("rank")


def _block_height(n: int) -> int:
    return min(_height(n), _height(BLOCK))


def _up(block: pa.Table) -> pa.Table:
    block = _ordered(block)
    n = block["n"][0].as_py()
    top, _ = forward(block["digest"].to_pylist(), _block_height(n))
    return pa.table({"tree": [block["tree"][0].as_py()], "rank": [block["block"][0].as_py()], "n": [-(-n // BLOCK)], "digest": [top]})


def _down(block: pa.Table, message: pa.Table) -> pa.Table:
    if not block.num_rows or not message.num_rows:
        raise ValueError("a block without its message")
    block = _ordered(block)
    _, nodes = forward(block["digest"].to_pylist(), _block_height(block["n"][0].as_py()))
    m = message.to_pylist()[0]
    steps, proofs = zip(*backward(nodes, block.num_rows, m["steps"], m["proof"]))
    out = block.drop_columns(["n", "block"])
    out = out.append_column("top", pa.array([m["top"]] * block.num_rows, pa.string()))
    return out.append_column("steps", pa.array(steps, pa.string())).append_column("proof", pa.array(proofs, pa.string()))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The written rows with ``rank`` (from 0) within their tree, ``n`` (rows of
    the tree) and ``block``. Ranges of the order are sorted; ranks follow from
    the number of rows of each (range, tree)."""
    keys = ["tree", *order, "tie"]
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), name)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.drop("tie").withColumn("pid", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id()), name)
    forget(rows)
    per = ranged.groupBy("pid", "tree").agg(F.min("mid").alias("low"), F.count(F.lit(1)).alias("c"))
    tree = Window.partitionBy("tree")
    per = per.select("pid", "tree", (F.sum("c").over(tree.orderBy("pid")) - F.col("c") - F.col("low")).alias("off"), F.sum("c").over(tree).alias("n"))
    out = ranged.join(per, ["pid", "tree"]).withColumn("rank", F.col("off") + F.col("mid"))
    out = materialize(_blocks(out.drop("pid", "mid", "off")), name)
    forget(ranged)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))


def _sweep_up(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The numbered nodes at the foot of each round, and the top of each tree
    (``tree``, ``digest``, ``round``)."""
    tables, tops, n = [leaves], None, leaves.agg(F.max("n")).first()[0] or 0
    while True:
        out = tables[-1].groupBy("tree", "block").applyInArrow(_up, "tree string, rank long, n long, digest string")
        out = materialize(out, "merkle-up")
        top = out.where("n = 1").select("tree", "digest", F.lit(len(tables) - 1).alias("round"))
        tops = top if tops is None else tops.unionByName(top)
        if n <= BLOCK:
            return tables, tops
        n = -(-n // BLOCK)
        tables.append(_blocks(out.where("n > 1")))


def _sweep_down(tables: list[DataFrame], messages: DataFrame) -> DataFrame:
    """The rows of the first table with ``top``, ``steps`` and ``proof``, for
    messages (``tree``, ``round``, ``top``, ``steps``, ``proof``) to the tops."""
    passed = None
    for r in range(len(tables) - 1, -1, -1):
        due = messages.where(F.col("round") == r).select("tree", F.lit(0).cast("long").alias("block"), "top", "steps", "proof")
        if passed is not None:
            due = due.unionByName(passed.select("tree", F.col("rank").alias("block"), "top", "steps", "proof"))
        schema = StructType([f for f in tables[r].schema.fields if f.name not in ("n", "block")] + StructType.fromDDL("top string, steps string, proof string").fields)
        passed = tables[r].groupBy("tree", "block").cogroup(due.groupBy("tree", "block")).applyInArrow(_down, schema)
        if r:
            passed = materialize(passed, "merkle-down")
    return passed


def manifest(docs: DataFrame, fields: tuple[str, ...], group_col: str = "source", order_col: str = "doc_id",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``key`` (``order_col``), ``leaf``, ``subroot``,
    ``root``, ``proof`` (the siblings' hex digests in a row, level by level via
    the subroot to the root, left to right), ``steps`` (per level two digits:
    nodes of the run and this node's place in it) and a struct ``carried`` of
    the columns ``carry`` (expressions over the input). ``fold`` recomputes a
    root from these.

    A leaf is ``leaf_digest`` of ``fields``. Leaves ascend by ``order_col``
    (NULL first; rows with equal keys by their digest, and equal rows in any
    order, whose proofs are then dealt to them in any order); groups ascend by
    the bytes of ``group_col``, NULL first and apart from the empty string. A
    lone leaf is its subroot, a lone subroot the root. NULLs in a field differ
    from empty values. Texts of any length are read whole; only digests travel.
    No other column of the input matters, whatever its name. No rows give no
    rows.
    """
    ship_package(docs.sparkSession)
    at = lambda c: F.col(f"`{c}`")
    tree = F.when(at(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), at(group_col).cast("string")))
    carried = F.struct(*[c.alias(k) for k, c in (carry or {}).items()] or [F.lit(None).cast("string").alias("none")])
    rows = docs.select(tree.alias("tree"), at(order_col).alias("key"), leaf_digest(*[at(f) for f in fields]).alias("digest"), carried.alias("carried"))
    tables, tops = _sweep_up(_numbered(rows, ["key", "digest"], "merkle-leaves"))
    subroots = _numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", "round"), ["key"], "merkle-subroots")
    above, root = _sweep_up(subroots)
    sent = root.select("tree", "round", F.col("digest").alias("top"), F.lit("").alias("steps"), F.lit("").alias("proof"))
    found = root.first()  # the one root
    found = found["digest"] if found else None
    # a subroot's message tells it its own digest as the top of its tree
    down = _sweep_down(above, sent).select(F.col("key").alias("tree"), "round", F.col("digest").alias("top"), "steps", "proof")
    out = _sweep_down(tables, materialize(down, "merkle-down"))
    return out.select("key", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(found).cast("string").alias("root"),
                      "proof", "steps", "carried")


def fold(leaf: Column, steps: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof. NULL if any is NULL."""
    def step(acc: Column, i: Column) -> Column:
        size = F.substr(steps, i * 2 + 1, F.lit(1)).cast("int")
        place = F.substr(steps, i * 2 + 2, F.lit(1)).cast("int")
        before = F.substr(proof, acc["at"] + 1, place * 64)
        after = F.substr(proof, acc["at"] + place * 64 + 1, (size - 1 - place) * 64)
        return F.struct(F.sha2(F.concat(before, acc["digest"], after).cast("binary"), 256).alias("digest"), (acc["at"] + (size - 1) * 64).alias("at"))

    levels = (F.length(steps) / 2).cast("int")  # none: the leaf is the root
    places = F.slice(F.sequence(F.lit(0), levels), F.lit(1), levels)
    start = F.struct(leaf.alias("digest"), F.lit(0).alias("at"))
    return F.aggregate(places, start, step)["digest"]
