"""Document fingerprints by consistent weighted sampling.

A text is a bag of terms: its words, each weighted by how often it occurs. For
every term and each of ``SIZE`` samples, three variates follow from a hash of
the term alone: r and c from Gamma(2, 1), b uniform. With weight w,

    t = floor(ln w / r + b),  ln y = r (t - b),  ln a = ln c - ln y - r

and the sample is the pair (term, t) with the least a. Two texts draw the same
pair with a probability that equals the generalised Jaccard similarity of their
weights, the sum of the lesser weights over the sum of the greater ones. As a
is the same only for the same pair, ln a itself stands for it, cut to 16 bits
by a hash; the share of equal samples estimates the similarity (``likeness``).

Gamma variates are read from a table of quantiles by 16 bits of the hash, so a
worker computes neither logarithms nor exponentials for them, and equal terms
get equal values in whatever place of an array they stand. Within an Arrow
batch each distinct text, and each distinct (term, weight), is computed once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import materialize, quoted, ship_package, slices
from quarry.llm.hashing import ODD, batch_words, mix
from quarry.operators.ordering import char_offsets

#: Samples of a fingerprint; bits of the hash that choose a quantile.
SIZE, _BITS = 128, 16
#: Text per batch, (term, weight) pairs and samples at once: memory bounds only.
SLICE_BYTES = 2 << 20
_PAIRS, _SAMPLES = 1 << 12, 32
#: The samples of a text without terms.
_NOTHING = 0


@cache
def gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2^16 equal shares, by Newton
    steps on 1 - (1 + x) exp(-x), rounded so that they do not depend on the
    last bits of a library's exponential."""
    u = (np.arange(1 << _BITS) + 0.5) / (1 << _BITS)
    x = np.where(u < 0.5, np.sqrt(2 * u), 1 - np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 2)
    return np.round(x, 9)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = gamma_quantiles()
    odd = mix((np.arange(SIZE, dtype=np.uint64) + np.uint64(1)) * ODD[1]) | np.uint64(1)
    return q.astype(np.float32), np.round(np.log(q), 9).astype(np.float32), odd


@cache
def _log(n: int) -> float:
    return round(math.log(n), 9)


def sample_costs(terms: np.ndarray, weights: np.ndarray, samples: slice = slice(0, SIZE)) -> np.ndarray:
    """ln a of samples (columns) for pairs (term hash, whole weight)."""
    q, log_q, odd = _tables()
    h = (terms[:, None] * odd[samples]).view(np.uint32)  # low and high half in turns
    low, high = h[:, ::2], h[:, 1::2]
    r, log_c = q[high >> np.uint32(_BITS)], log_q[high & np.uint32((1 << _BITS) - 1)]
    b = (low >> np.uint32(8)).astype(np.float32) * np.float32(2.0**-24)
    several = np.flatnonzero(weights > 1)
    if len(several):  # of weight 1, ln w and so t are 0
        least, number = np.unique(weights[several], return_inverse=True)
        log_w = np.array([_log(int(w)) for w in least], np.float32)[number]
        b[several] -= np.floor(log_w[:, None] / r[several] + b[several])
    b -= np.float32(1.0)
    b *= r
    b += log_c
    return b


def _cut(costs: np.ndarray) -> np.ndarray:
    """16 bits, not all zero, that stand for a least cost."""
    with np.errstate(over="ignore"):
        bits = mix(costs.view(np.uint32).astype(np.uint64) + ODD[1])
    return 1 + (bits % np.uint64(0xFFFF)).astype(np.uint16)


def signatures(hashes: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit samples (a row per text) for texts of numbered words in a row;
    ``hashes`` are those of the distinct words."""
    texts = len(bounds) - 1
    out = np.full((texts, SIZE), _NOTHING, np.uint16)
    if not len(number):
        return out
    text = np.repeat(np.arange(texts), np.diff(bounds))
    term, weight = np.unique(text * len(hashes) + number, return_counts=True)
    text, term = term // len(hashes), term % len(hashes)
    least = np.zeros((texts, SIZE), np.float32)
    if texts == 1:  # of any length
        parts = [sample_costs(hashes[term[a : a + _PAIRS]], weight[a : a + _PAIRS]).min(axis=0) for a in range(0, len(term), _PAIRS)]
        out[0] = _cut(np.min(parts, axis=0))
        return out
    most = int(weight.max()) + 1
    pair, of = np.unique(term * most + weight, return_inverse=True)
    begin = np.searchsorted(text, np.arange(texts + 1)).tolist()
    for first in range(0, SIZE, _SAMPLES):
        samples = slice(first, first + _SAMPLES)
        costs = np.empty((len(pair), _SAMPLES), np.float32)
        for lo in range(0, len(pair), _PAIRS):
            some = pair[lo : lo + _PAIRS]
            costs[lo : lo + _PAIRS] = sample_costs(hashes[some // most], some % most, samples)
        for i, (a, b) in enumerate(zip(begin, begin[1:])):
            if b > a:
                np.min(costs[of[a:b]], axis=0, out=least[i, samples])
    some = np.flatnonzero(np.diff(begin))  # texts with words
    out[some] = _cut(least[some])
    return out


def _fingerprints(columns: int):
    """Adds the fingerprints of the first ``columns`` columns. A row's texts
    stand side by side, as they share most of their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES, 0):
                rows = batch.num_rows
                every = pa.concat_arrays([batch.column(i).cast(pa.large_string()) for i in range(columns)])
                every = every.take(pa.array(np.arange(rows * columns).reshape(columns, rows).T.ravel())).dictionary_encode()
                distinct = pa.RecordBatch.from_arrays([every.dictionary], names=["text"])
                made = np.concatenate([signatures(*batch_words(part.column(0).cast(pa.string())))
                                       for part in slices(distinct, columns * SLICE_BYTES, 0)])
                prints = made[every.indices.to_numpy()].reshape(rows, columns, SIZE)
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * SIZE)
                yield pa.RecordBatch.from_arrays(
                    batch.columns[columns:] + [pa.ListArray.from_arrays(offsets, pa.array(prints[:, i].ravel().view(np.int16))) for i in range(columns)],
                    names=[*batch.schema.names[columns:], *[f"fingerprint_{i}" for i in range(columns)]])

    return run


def fingerprint(rows: DataFrame, texts: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and, under the names of ``texts``, the fingerprint
    of each of these texts: an array of ``SIZE`` samples of 16 bits (signed).

    Terms are the words between ASCII white space, weighted by their number.
    NULL texts count as empty; a text without words has the fingerprint of
    zeros, which no other text has in any sample. Equal texts have equal
    fingerprints in any batch and any row. Texts of any length are read whole:
    a task holds a slice of 2 MB, and 128 bytes for each distinct (word, count)
    in it, or one text. No rows give no rows.
    """
    ship_package(rows.sparkSession)
    clean = [F.coalesce(c.cast("string"), F.lit("")).alias(f"text_{i}") for i, c in enumerate(texts.values())]
    kept = rows.select(F.struct(*[c.alias(k) for k, c in keep.items()]).alias("kept"), *clean).select(*[f"text_{i}" for i in range(len(clean))], "kept")
    schema = StructType([kept.schema["kept"]] + StructType.fromDDL(", ".join(f"fingerprint_{i} array<smallint>" for i in range(len(clean)))).fields)
    out = kept.mapInArrow(_fingerprints(len(clean)), schema)
    return out.select("kept.*", *[F.col(f"fingerprint_{i}").alias(name) for i, name in enumerate(texts)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints, 0 to 1. Two texts without
    words are alike (1)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(SIZE))


def as_text(fingerprint: Column) -> Column:
    """The samples as hexadecimal numbers with a space between."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.hex(x.cast("int").bitwiseAND(0xFFFF))), " "))


#: Most ranges of ``with_next`` (their first keys, 17 bytes each, are collected
#: and sent with the plan), and ranges to a shuffle partition on a small input.
MOST_RANGES, _RANGES_EACH = 100_000, 8


def _order(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """The place of a row in ascending id: NULL first, then by a hash of the text."""
    known = F.col(quoted(id_col)).cast("long")
    return {"set": known.isNotNull(), "id": F.coalesce(known, F.lit(0)), "hash": F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))}


def text_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The sorted first keys of ranges of about equal text in ascending id, by
    the sizes of all texts, as a literal list of at most ``MOST_RANGES``."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(quoted(text_col)).cast("string")), F.lit(0)) + 64
    order = F.struct(*[c.alias(k) for k, c in _order(docs, id_col, text_col).items()])
    sizes = materialize(docs.select(order.alias("_o"), size.cast("long").alias("_len")), "sizes")
    total = sizes.agg(F.sum("_len")).first()[0] or 0
    ranges = _RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(MOST_RANGES, max(ranges, total >> 26)))  # of 64 MB at most, as far as MOST_RANGES goes
    wide = max(1, -(-total // ranges))
    starts = char_offsets(sizes, []).groupBy(F.floor(F.col("start") / wide).alias("r")).agg(F.min("_o").alias("k"))
    first = sorted({tuple(k) for (k,) in starts.select("k").collect()})
    return F.from_json(F.lit(json.dumps([{"set": known, "id": i, "hash": h} for known, i, h in first])), "array<struct<set:boolean,id:bigint,hash:bigint>>")


def _range_of(first: Column, key: Column) -> Column:
    """The last place of the sorted list whose value is not over the key, by
    bisection."""
    def halve(at: Column, _: Column) -> Column:
        middle = ((at["lo"] + at["hi"]) / 2).cast("int")
        low = F.get(first, middle) <= key
        done = at["lo"] + 1 >= at["hi"]
        return F.struct(F.when(~done & low, middle).otherwise(at["lo"]).alias("lo"), F.when(done | low, at["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(MOST_RANGES.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(first).alias("hi")), halve)["lo"]


def with_next(rows: DataFrame, ranges: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
              carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id``, ``text`` (NULL: empty), ``next_text``, the text of
    the row after it in ascending id (the last row's is the first's), and for
    each column named in ``carry`` this row's and the next row's (``next_...``).

    NULL ids come first. Rows of one id are ordered by a hash of their text, so
    equal rows follow each other. A lone row is its own next. No rows give no
    rows. Other columns are dropped, whatever their name.

    Each row travels once, to its range of ``ranges`` (default: ``text_ranges``
    of the rows); the first row of a range goes to the range before it as well.
    """
    ship_package(rows.sparkSession)
    first = text_ranges(rows, id_col, text_col) if ranges is None else ranges
    place = _order(rows, id_col, text_col)
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    also = F.struct(*[F.col(quoted(c)).alias(c) for c in carry] or [F.lit(None).cast("string").alias("none")])
    src = rows.select(*[c.alias(k) for k, c in place.items()], F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"), also.alias("also"))
    key = F.struct("set", "id", "hash")
    src = src.withColumn("own", _range_of(first, key))
    before = F.pmod(F.col("own") - 1, F.size(first))
    to = F.when(F.get(first, F.col("own")) == key, F.array("own", before)).otherwise(F.array("own"))
    dealt = src.select("set", "id", "hash", "doc_id", "text", "also", F.posexplode(to).alias("copy", "range"))
    # a copy from the range after it comes last, also in the only range
    along = Window.partitionBy("range").orderBy("copy", "set", "id", "hash")
    out = dealt.select("copy", "doc_id", "text", "also", F.lead("text").over(along).alias("next_text"), F.lead("also").over(along).alias("next")).where("copy = 0")
    both = [F.col(f"{of}.{quoted(c)}").alias(name + c) for c in carry for of, name in (("also", ""), ("next", "next_"))]
    return out.select("doc_id", "text", "next_text", *both)
