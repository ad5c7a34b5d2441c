"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming
join, and confirmation on whole shingle sets.

Documents with equal shingle sets are one node. A signature is CHUNKS x WIDTH
symbols of 16 bits. By the pigeonhole principle two signatures that differ in
at most CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS
differences, so each node is indexed under every chunk with every choice of
ERRORS symbols left out: all pairs within that distance meet under a key.

Signatures travel with their nodes: two nodes that meet under a key are
candidates only if their signatures differ in up to FAR symbols, which is
tested before any shingle set is fetched. Pairs are never written out.
Candidates are confirmed in three steps:

* star: each node is compared with one likely centre of the groups that it
  meets; whole groups of near copies fall together at a cost linear in them;
* sieve: where nodes that meet under a key are still in different components,
  cells compare the signatures of all nodes that share a key and return a
  spanning forest of the candidates, so that texts which share a key by chance
  do not chain up to large groups;
* cells: the trees of that forest, now with their sets, are dealt into blocks
  of bounded size, and each pair of blocks compares all its candidates and
  returns a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from quarry.llm.common import forget, materialize, slices, texts
from quarry.llm.components import connected_components, least_of_group
from quarry.llm.hashing import ODD, batch_hashes, gram_hashes, mix

#: Signature of 35 symbols: all pairs that differ in up to 13 are candidates,
#: and a pair with a similarity of 0.85 (0.8) is missed with a probability of
#: 3e-6 (9e-5).
CHUNKS, WIDTH, ERRORS = 7, 5, 1
#: Most symbols in which the signatures of candidates differ. A pair with a
#: similarity of 0.85 (0.8) is beyond it with a probability of 2e-7 (2e-5).
FAR = 17
#: Bytes and members of a block; a cell holds two.
BLOCK_BYTES, BLOCK_MEMBERS = 8 << 20, 2048
#: Cells that small groups are dealt into, to a shuffle partition.
CELLS_EACH = 4
SLICE_BYTES = 8 << 20

_CHOSEN = [[c * WIDTH + i for i in kept] for c in range(CHUNKS) for kept in combinations(range(WIDTH), WIDTH - ERRORS)]
_SEEDS = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=7) for i in range(2 * CHUNKS * WIDTH)], np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; fewer words than ``size`` are one
    shingle, no words none."""
    if not len(words):
        return words
    n = min(size, len(words))
    return np.unique(gram_hashes(words, n) + np.uint64(size - n))


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of the least hash of a shingle set under each hash function."""
    times, plus = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]
    low = np.array([(found * t + p).min() for t, p in zip(times, plus)], np.uint64)
    return (low >> np.uint64(8)) & np.uint64(0xFFFF)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """A signature's keys: each chunk with each choice of symbols left out."""
    packed = np.zeros(len(_CHOSEN), np.uint64)
    for column in zip(*_CHOSEN):
        packed = packed * ODD[1] + mix(symbols[list(column)] + np.uint64(1))
    return mix(packed + np.arange(len(_CHOSEN), dtype=np.uint64) * ODD[0])


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                words, bounds = batch_hashes(batch.column(1), lower=True)
                rows = []
                for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
                    found = shingles(words[i:j], size)
                    signed = signature(found) if len(found) else None
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None,
                                 index_keys(signed).view(np.int64) if len(found) else None, signed.astype("<u2").tobytes() if len(found) else None))
                cells = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.binary()), pa.array(cells[2], pa.list_(pa.int64())),
                     pa.array(cells[3], pa.binary())], names=["doc_id", "h", "n", "node", "keys", "sign"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                words, bounds = batch_hashes(batch.column(1), lower=True)
                found = [shingles(words[i:j], size).view(np.int64) for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    return run


def similar(both, either, percent: int):
    """The rule for a link, in whole numbers."""
    return 100 * both >= percent * either


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Sizes that a link allows at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def symbols(signs) -> np.ndarray:
    """Signatures as rows of symbols."""
    return np.frombuffer(b"".join(signs), "<u2").reshape(-1, CHUNKS * WIDTH)


@pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((symbols(a) != symbols(b)).sum(axis=1) <= FAR)


def links_in_cell(left: np.ndarray, right: np.ndarray, keys: list[np.ndarray], signs: np.ndarray, size: np.ndarray,
                  root: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """For every member of a cell the least member that it is linked with,
    directly or not. Compared are the pairs of a left and a right member that
    share a key, have different roots and are candidates by size and signature;
    without ``sets`` each of them is a link. Sets must be sorted."""
    n = len(keys)
    owner = np.repeat(np.arange(n), [len(k) for k in keys])
    _, key = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.argsort(key, kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(key))]
    holders = owner[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    if sets is not None:
        at = np.cumsum([0, *map(len, sets)])
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        here = np.zeros(int(token.max(initial=-1)) + 1, bool)
    is_left, is_right = np.zeros(n, bool), np.zeros(n, bool)
    is_left[left], is_right[right] = True, True
    label = np.arange(n)
    for a in np.flatnonzero(is_left):
        others = np.unique(np.concatenate([holders[bounds[k] : bounds[k + 1]] for k in np.unique(key[first[a] : first[a + 1]])]))
        others = others[is_right[others] & (root[others] != root[a]) & (100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a]))]
        # a pair that is in the cell both ways is compared once
        others = others[~(is_left[others] & is_right[a]) | (others > a)]
        others = others[label[others] != label[a]]
        others = others[(signs[others] != signs[a]).sum(axis=1) <= FAR]
        if not len(others):
            continue
        if sets is None:
            linked = others
        else:
            here[token[at[a] : at[a + 1]]] = True
            both = np.array([np.count_nonzero(here[token[at[b] : at[b + 1]]]) for b in others])
            here[token[at[a] : at[a + 1]]] = False
            linked = others[similar(both, size[others] + size[a] - both, percent)]
        if len(linked):
            label = least_of_group(n, label[np.full(len(linked), a)], label[linked])[label]
    return label


def _cell(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        left, right = np.flatnonzero(rows.block == i), np.flatnonzero(rows.block == j)
        node = rows.node.to_numpy()
        _, root = np.unique(rows.root.to_numpy(), return_inverse=True)
        sets = [np.asarray(s) for s in rows.found] if "found" in rows.columns else None
        label = links_in_cell(left, right, [np.asarray(k) for k in rows["keys"]], symbols(rows.sign), rows.n.to_numpy(), root, percent, sets)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    return run


def _stars(met: DataFrame, percent: int) -> DataFrame:
    """For each node one likely centre: of the nodes that share the most
    entries with others under its keys, the one it meets most often."""
    weight = met.groupBy("node").agg(F.sum("times").alias("weight"))
    weighed = met.join(weight, "node")
    centre = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("centre"))
    near = weighed.join(centre, "key").where((F.col("node") != F.col("centre.node")) & _alike(F.col("n"), F.col("centre.n"), percent))
    often = near.groupBy("node", F.col("centre.node").alias("to")).agg(F.count(F.lit(1)).alias("times"))
    return often.groupBy("node").agg(F.max(F.struct("times", "to")).alias("best")).select("node", F.col("best.to").alias("to"))


def _in_cells(members: DataFrame, percent: int, size: Column) -> DataFrame:
    """Links between the members (``group``, ``node``, ``root``, ``keys``,
    ``sign``, ``n`` and, if they are to be compared, their sets ``found``) of
    each group, a member having ``size`` bytes. Pairs of blocks make cells."""
    spark = members.sparkSession
    sizes = members.groupBy("group").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("members"))
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("members") / BLOCK_MEMBERS)).cast("int")), "sizes")
    packs = max(CELLS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")),
                1 + (sizes.where("blocks = 1").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // BLOCK_BYTES))
    dealt = members.join(sizes.select("group", "blocks"), "group")
    # groups of one block share cells; a larger group has cells of its own
    dealt = dealt.withColumn("pack", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(packs)))) \
        .withColumn("big", F.when(F.col("blocks") > 1, F.col("group"))) \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = ["found"] if "found" in members.columns else []
    return dealt.select("big", "pack", "i", "j", "block", "node", "root", "keys", "sign", "n", *found) \
        .groupBy("big", "pack", "i", "j").applyInPandas(_cell(percent), "a binary, b binary")


def _cells(met: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that share a key and are in different components."""
    rooted = met.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = materialize(rooted.join(mixed, "key", "left_semi"), "rest")
    head = rest.groupBy("key").agg(F.min("node").alias("b"))
    groups = connected_components(rest.join(head, "key").select(F.col("node").alias("a"), "b"))
    members = rest.groupBy("node").agg(F.first("root").alias("root"), F.collect_list("key").alias("keys"))
    members = members.join(nodes.select("node", "sign", "n"), "node").join(groups.withColumnRenamed("root", "group"), "node")
    members = materialize(members.select("group", "node", "root", "keys", "sign", "n"), "members")
    forget(rest)
    # sieve: by signatures alone
    trees = connected_components(materialize(_in_cells(members, percent, 2 * CHUNKS * WIDTH + 8 * F.size("keys")), "candidates"))
    close = members.drop("group").join(trees.withColumnRenamed("root", "group"), "node").join(sets, "node")
    close = materialize(close.select("group", "node", "root", "keys", "sign", "n", "found"), "members")
    return _in_cells(close, percent, 8 * (F.size("found") + F.size("keys")))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id`` (least doc_id
    reachable by links), ``kept`` (it is its own), ``text_hash`` and ``head``
    (the row is, up to equal rows, the first of its component by doc_id and
    text_hash).

    Words are parted by ASCII white space, A-Z lower-cased. Two documents are
    linked if their sets of distinct shingles have 100 * intersection >=
    ``percent`` * union. A text with fewer words is one shingle; NULL texts and
    texts without words have none, link with nothing and are kept. Rows that
    repeat a doc_id stay rows of their own; a NULL doc_id links like any other
    but is never a component's least id. No rows give no rows. Long texts are read
    whole, each in one task. Other columns do not matter, whatever their name.
    """
    if not 0 < percent <= 100 or shingle_words < 1:
        raise ValueError("percent must be 1 to 100, shingle_words at least 1")
    src = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    signed = materialize(src.select("doc_id", "text", "h").mapInArrow(
        _sign(shingle_words), "doc_id long, h long, n long, node binary, keys array<long>, sign binary"), "signed")
    nodes = materialize(signed.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sign").alias("sign")), "nodes")

    entries = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    met = materialize(entries.join(shared, "key"), "met")

    # signatures are compared before any set is fetched
    signs = nodes.select("node", "sign")
    stars = _stars(met, percent).join(signs, "node").join(signs.select(F.col("node").alias("to"), F.col("sign").alias("theirs")), "to")
    stars = materialize(stars.where(_near("sign", "theirs")).select("node", "to"), "stars")

    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("at.doc_id").alias("id"), F.col("at.h").alias("h"))
    from_text = src.alias("s").join(wanted.alias("w"), F.col("s.doc_id").eqNullSafe(F.col("w.id")) & (F.col("s.h") == F.col("w.h")))
    sets = materialize(from_text.select("node", "text").mapInArrow(_sets(shingle_words), "node binary, found array<long>"), "sets")

    compared = stars.join(sets, "node").select("node", "to", F.col("found").alias("a")) \
        .join(sets.select(F.col("node").alias("to"), F.col("found").alias("b")), "to").withColumn("both", F.size(F.array_intersect("a", "b")))
    confirmed = compared.where(similar(F.col("both"), F.size("a") + F.size("b") - F.col("both"), percent))
    roots = connected_components(materialize(confirmed.select(F.col("node").alias("a"), F.col("to").alias("b")), "stars"))

    more = materialize(_cells(met, roots, nodes, sets, percent), "links")
    forget(met, sets)
    groups = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    of = nodes.select("node", "least", "at").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = materialize(of, "classes")
    # written first, so that Spark can split the join where a class is very large
    least = materialize(of.groupBy("root").agg(F.min("least").alias("component_id"), F.min("at").alias("first")), "least")
    out = signed.select("doc_id", "h", "n", "node").join(of.join(least, "root").select("node", "component_id", "first"), "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("h").alias("text_hash"), (alone | F.struct("doc_id", "h").eqNullSafe(F.col("first"))).alias("head")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
