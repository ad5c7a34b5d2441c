"""Substring dedup: the words of repeated windows, found by hashes.

The method dealt, greedy relative Lempel-Ziv factoring against indexed
reference blocks, is not used: a document's reference is all text before it, so
factoring would read every document once for each block before it (the README
has the count). Repeats are found by content-defined phrases instead:

1. Content decides where a text is cut into phrases, runs of windows that share
   their least 5-gram, the anchor; the phrases are dealt by the hashes of anchor
   and content, so that equal passages meet wherever they stand.
2. Phrases whose anchor occurs only once in the corpus have no counterpart.
3. Of the others, a phrase with an earlier occurrence is a repeat as a whole.
4. A repeat can begin or end inside a phrase. So in the phrases that are the
   first of their content but share their anchor with other contents, every
   single window is looked up as well.

A window lies in exactly one phrase and equal windows have equal anchors, so
the words covered are exactly those of windows that start earlier somewhere.
Rows meet by hash only; counts and least positions are aggregated before each
shuffle, so a passage of a third of all documents is no large group. Hashes
have 128 bits, and so has the key of a row: its id and the hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import forget, materialize, slices, texts
from quarry.llm.hashing import ODD, batch_hashes, gram_hashes, mix

#: Words of a window; words of an anchor.
WINDOW, ANCHOR = 20, 5
#: Text per batch: a memory bound only.
SLICE_BYTES = 4 << 20
#: A row is known by its id and the two halves of its text's hash, which also
#: order rows of one id; a position is (row, word). A NULL id sorts first.
ROW = ("id", "t1", "t2")
_ROW_DDL = "id long, t1 long, t2 long"
_NULL_ID = -(1 << 63)


def phrases(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Text, start in the row of all words, number of windows, anchor and
    content hash of every phrase of several texts in a row."""
    if len(words) < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = gram_hashes(words, ANCHOR, ODD[0])
    starts = np.arange(len(words) - window + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(starts)]
    inside = starts + window <= bounds[text + 1]
    anchor = np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1).argmin(axis=1)
    starts, anchor, text = starts[inside], (anchor + starts)[inside], text[inside]
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    windows = gram_hashes(words, window, ODD[1])[inside]
    # order matters: each window is mixed with its place in the phrase
    place = np.arange(len(anchor)) - np.repeat(first, count)
    content = np.add.reduceat(mix(windows + place.astype(np.uint64) * ODD[0]), first) + count.astype(np.uint64)
    return text[first], starts[first], count, grams[anchor[first]], mix(content)


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                words, bounds = batch_hashes(batch.column(1))
                text, start, count, anchor, content = phrases(words, bounds, window)
                made = ((start - bounds[text]).astype(np.int32), count.astype(np.int32), anchor.view(np.int64), content.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(pa.array(text)) for i in (0, 2, 3)] + [pa.array(c) for c in made],
                    names=[*ROW, "place", "n", "anchor", "content"])

    return run


def _windows(window: int):
    """Both hashes of each window of the phrases listed for a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                words, bounds = batch_hashes(batch.column(1))
                listed = batch.column(4)
                size = np.diff(listed.offsets.to_numpy())
                place, n = (listed.flatten().field(c).to_numpy().astype(np.int64) for c in ("place", "n"))
                text = np.repeat(np.repeat(np.arange(len(size)), size), n)
                places = np.repeat(place, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                one, two = (gram_hashes(words, window, base)[places + bounds[text]].view(np.int64) for base in ODD)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(pa.array(text)) for i in (0, 2, 3)] + [pa.array(c) for c in (places.astype(np.int32), one, two)],
                    names=[*ROW, "place", "one", "two"])

    return run


def _cut(window: int, keep: int):
    """Removed ranges and kept text of each document. The last two columns are
    its repeated runs of windows and the number of equal rows before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                rows = []
                for text, runs, earlier in zip(*[batch.column(i).to_pylist() for i in (1, keep + 2, keep + 3)]):
                    words = text.encode("utf-8", "surrogatepass").split()
                    n = len(words)
                    if earlier and n >= window:
                        factors = [(0, n)]
                    else:
                        factors = factors_of([(x["place"], x["n"]) for x in runs or []], window)
                    gone = sum(b - a for a, b in factors)
                    if gone:
                        kept, at = [], 0
                        for a, b in factors:
                            kept += words[at:a]
                            at = b
                        words = kept + words[at:]
                    rows.append((b" ".join(words).decode("utf-8", "surrogatepass"), n, gone, [{"start": a, "stop": b} for a, b in factors]))
                cells = list(zip(*rows))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(2 + keep)] + [pa.array(c, k) for c, k in zip(cells, kinds)],
                                                 names=[*batch.schema.names[: 2 + keep], "kept_text", "n_words", "n_removed", "factors"])

    return run


def factors_of(runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Word ranges covered by runs of windows (start, number of windows), those
    that touch joined to one."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(runs):
        stop = start + n + window - 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first position of each key, and how often the key occurs."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*ROW, "place", "n")).alias("first"), F.count(F.lit(1)).alias("times"))


def _later(rows: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of rows that are not the first of their key."""
    known = first.where("times > 1").select(*keys, "first")
    return rows.join(known, keys).where(F.struct(*ROW, "place", "n") > F.col("first")).select(*ROW, "place", "n")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document ``doc_id``, ``text``, ``kept`` (a struct of the columns
    named in ``keep``, if any), ``kept_text`` (the words that stay, joined by
    one space), ``n_words``, ``n_removed`` and ``factors`` (the removed word
    ranges).

    Removed is each word in a window of ``window`` words whose sequence also
    starts earlier: in a smaller doc_id, or earlier in the same document. Words
    are parted by ASCII white space. NULL texts have no words; shorter texts
    lose none. NULL doc_ids come first; rows of one doc_id with different texts
    are ordered by a hash of their text; of equal rows one counts as the first
    and the others, if long enough, lose all words. No rows give no rows.
    """
    src = texts(docs, id_col, text_col, keep)
    keyed = src.withColumns({"id": F.coalesce("doc_id", F.lit(_NULL_ID)), "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})

    found = materialize(keyed.select("id", "text", "t1", "t2").mapInArrow(
        _parse(window), f"{_ROW_DDL}, place int, n int, anchor long, content long"), "phrases")
    # written first, so that the join below is one that Spark can split where an anchor is very common
    shared = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"), "anchors")
    repeated = materialize(found.join(shared, "anchor", "left_semi"), "repeated")
    forget(found, shared)

    first = materialize(_first(repeated, ["anchor", "content"]), "firsts")
    copied = materialize(_later(repeated, first, ["anchor", "content"]), "copied")
    forget(repeated)
    sized = first.select("anchor", "first.*")
    several = materialize(sized.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"), "anchors")
    listed = sized.join(several, "anchor", "left_semi").groupBy(*ROW).agg(F.collect_list(F.struct("place", "n")).alias("listed"))

    # equal rows list the same positions twice, which changes no least position
    look = keyed.select(*ROW, "text").join(listed, [*ROW]).select("id", "text", "t1", "t2", "listed")
    edges = materialize(look.mapInArrow(_windows(window), f"{_ROW_DDL}, place int, one long, two long"), "windows")
    forget(first)
    edges = edges.withColumn("n", F.lit(1))
    least = materialize(_first(edges, ["one", "two"]).where("times > 1"), "least")
    inside = materialize(_later(edges, least, ["one", "two"]), "inside")
    forget(edges, least, several)

    runs = copied.unionByName(inside).groupBy(*ROW).agg(F.collect_list(F.struct("place", "n")).alias("runs"))
    equal = Window.partitionBy(*ROW).orderBy("id")
    kept = ["kept"] if keep else []
    ready = keyed.join(runs, [*ROW], "left") \
        .select("doc_id", "text", *kept, "runs", (F.row_number().over(equal) - 1).alias("earlier"))
    schema = StructType(src.schema.fields + StructType.fromDDL(
        "kept_text string, n_words long, n_removed long, factors array<struct<start:int,stop:int>>").fields)
    return ready.mapInArrow(_cut(window, len(kept)), schema)
