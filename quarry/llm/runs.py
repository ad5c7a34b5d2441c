"""Periodic runs of words by branching tandem repeats of an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q, at least
``max(shortest, 2 * q)`` words long, that no neighbouring word extends. A task
handles the texts of an Arrow batch together, whole documents in numpy arrays:

1. Both copies of the first words of a run repeat its first ``shortest / 2``
   words or more, and such repeats cover the run. Only stretches of words whose
   grams of that length occur again in their document go on; a gram is compared
   by its hash, which can only let too much through.
2. Suffix array, its inverse (ISA) and the LCP array of these stretches. Words
   of different documents differ, and every stretch ends with a symbol of its
   own.
3. Each boundary of depth d in the LCP array parts its LCP interval in two. For
   every suffix i in the smaller part, ISA[i + d] or ISA[i - d] lies in the
   other part exactly if a branching square of period d starts at i or i - d.
   The interval is given by the nearest smaller LCP values; no tree is built,
   and no more than n log n suffixes are looked at.
4. Every run ends with exactly one branching square of its period. It is
   rotated to the left as far as the words agree, which gives the run's start;
   squares of a multiple of the period that lie inside merge with the run.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import slices, texts
from quarry.llm.hashing import gram_hashes, mix

#: Least words of a run.
SHORTEST = 12
#: Text per batch and words compared at once: memory bounds only.
SLICE_BYTES = 4 << 20
_COMPARED = 1 << 22


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``s`` and its inverse, by prefix doubling; in each round
    only suffixes that are not told apart yet are sorted. The last symbol must
    be unique."""
    order = np.argsort(s)
    ranked = s[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places of the order in groups of several
    k = 1
    while len(slots):
        group = order[slots]
        key = rank[group] * len(s) + rank[group + k]
        by = np.argsort(key)
        group, key = group[by], key[by]
        order[slots] = group
        new = np.r_[True, key[1:] != key[:-1]]
        rank[group] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.r_[new[1:], True])]
        k *= 2
    return order, rank


def common_prefix(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, pairwise.
    The last symbol must be unique."""
    length = np.zeros(len(a), np.int64)
    live = np.flatnonzero(a != b)
    while len(live):
        wide = min(4096, max(4, _COMPARED // len(live)))
        still = []
        for part in np.array_split(live, -(-len(live) * wide // _COMPARED)):
            at = length[part][:, None] + np.arange(wide)
            same = s[np.minimum(a[part][:, None] + at, len(s) - 1)] == s[np.minimum(b[part][:, None] + at, len(s) - 1)]
            whole = same.all(axis=1)
            length[part] += np.where(whole, wide, same.argmin(axis=1))
            still.append(part[whole])
        live = np.concatenate(still)
    return length


def lcp_array(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``. Words are
    compared only where the words before the two suffixes differ; elsewhere
    the value is one less than that of the suffix before it in the text."""
    phi = np.empty(len(s), np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = sa[0]
    apart = np.r_[True, (s[:-1] != s[phi[1:] - 1]) | (phi[1:] == 0)]
    apart[sa[0]] = True
    at = np.flatnonzero(apart)
    reach = np.zeros(len(s), np.int64)
    reach[at] = common_prefix(s, at, phi[at]) + at
    return (np.maximum.accumulate(reach) - np.arange(len(s)))[sa]


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary k with ``lcp[k] > 0`` the bounds ``left < k < right``
    of the suffixes that it parts: the nearest smaller value before it and the
    nearest not larger value after it. ``lcp[0]`` is 0."""
    left, right = array("q", bytes(8 * len(lcp))), array("q", bytes(8 * len(lcp)))
    stack: list[int] = []
    depth: list[int] = []
    base = k = 0
    for lo in range(0, len(lcp), 1 << 18):
        for d in lcp[lo : lo + (1 << 18)].tolist():
            while depth and depth[-1] >= d:
                depth.pop()
                right[stack.pop()] = k
            if d:
                left[k] = stack[-1] if stack else base
                stack.append(k)
                depth.append(d)
            else:
                base = k
            k += 1
    for j in stack:
        right[j] = k
    return np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square ``s[i:i+d] == s[i+d:i+2*d]`` whose next
    symbol ends it. The last symbol must be unique."""
    sa, isa = suffix_array(s)
    lcp = lcp_array(s, sa)
    left, right = intervals(lcp)
    k = np.flatnonzero(lcp > 0)
    left, right, depth = left[k], right[k], lcp[k]
    small_left = k - left <= right - k
    begin, size = np.where(small_left, left, k), np.where(small_left, k - left, right - k)
    far, far_end = np.where(small_left, k, left), np.where(small_left, right, k)
    starts, periods = [], []
    upto = np.cumsum(size)
    lo = 0
    while lo < len(k):  # parts of bounded size
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _COMPARED, "right")))
        n = size[lo:hi]
        of = np.repeat(np.arange(lo, hi), n)
        i = sa[begin[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        d = depth[of]
        for j, first in ((i + d, i), (i - d, i - d)):
            at = isa[np.maximum(j, 0)]
            hit = (j >= 0) & (at >= far[of]) & (at < far_end[of])
            starts.append(first[hit])
            periods.append(d[hit])
        lo = hi
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def merge_runs(s: np.ndarray, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of the runs that end with the given
    branching squares. The first symbol must be unique."""
    back = s[::-1]
    end = start + 2 * period
    by = np.lexsort((period, end))
    end, period = end[by], period[by]
    out = []
    while len(end):
        head = np.r_[True, end[1:] != end[:-1]]  # the least period that ends here
        of = np.cumsum(head) - 1
        e, q = end[head], period[head]
        first = e - 2 * q
        first = first - common_prefix(back, len(s) - first, len(s) - first - q)  # rotated to the left
        out.append((first, e - first, q))
        inside = (period % q[of] == 0) & (end - 2 * period >= first[of])
        end, period = end[~inside], period[~inside]
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def find_runs(number: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """Text, start (word of the text), length and period of every run, ordered
    by these, for texts of numbered words in a row."""
    gram, n = max(1, shortest // 2), len(number)
    none = (np.empty(0, np.int64),) * 4
    if n < gram:
        return none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n - gram + 1)
    at = at[at + gram <= bounds[text[at] + 1]]
    if not len(at):
        return none
    with np.errstate(over="ignore"):
        words = mix(number.astype(np.uint64) + np.uint64(1))
        key = mix(gram_hashes(words, gram)[at] ^ mix(text[at].astype(np.uint64) + np.uint64(1)))
    by = np.argsort(key)
    key = key[by]
    twice = key[1:] == key[:-1]
    again = at[by[np.r_[False, twice] | np.r_[twice, False]]]
    if not len(again):
        return none
    edge = np.zeros(n + 1, np.int64)
    edge[again] += 1  # each place once
    np.subtract.at(edge, again + gram, 1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    new = np.r_[True, (kept[1:] != kept[:-1] + 1) | (text[kept[1:]] != text[kept[:-1]])]
    place = np.arange(len(kept)) + np.cumsum(new)
    many = int(number.max()) + 1
    s = np.empty(len(kept) + int(new.sum()) + 1, np.int64)
    ends = np.ones(len(s), bool)
    ends[place] = False
    s[place] = text[kept] * many + number[kept]
    s[ends] = len(bounds) * many + np.arange(int(ends.sum()))
    first, length, period = merge_runs(s, *branching_squares(s))
    long = length >= np.maximum(shortest, 2 * period)
    origin = np.zeros(len(s), np.int64)
    origin[place] = kept
    start, length, period = origin[first[long]], length[long], period[long]
    of = text[start]
    start = start - bounds[of]
    by = np.lexsort((period, start, of))
    return of[by], start[by], length[by], period[by]


def batch_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII white space) of a batch's texts in a row, and
    the bounds of each text."""
    cut = pc.ascii_split_whitespace(column)
    bounds = cut.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    flat = cut.flatten()
    word = pc.greater(pc.binary_length(flat), 0)
    bounds = np.append(0, np.cumsum(word.to_numpy(zero_copy_only=False)))[bounds]
    return flat.filter(word), bounds


def _offsets(bounds: np.ndarray) -> pa.Array:
    return pa.array(bounds.astype(np.int32))


def _collapse(shortest: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                words, bounds = batch_words(batch.column(1))
                of, start, length, period = find_runs(words.dictionary_encode().indices.to_numpy(), bounds, shortest)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, bounds[of] + start + period, 1)
                np.subtract.at(edge, bounds[of] + start + length, 1)
                stays = np.cumsum(edge[:-1]) == 0
                left = pa.ListArray.from_arrays(_offsets(np.append(0, np.cumsum(stays))[bounds]), words.filter(pa.array(stays)))
                runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(_offsets(np.searchsorted(of, np.arange(len(bounds)))), runs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(2 + keep)] + [pa.array(np.diff(bounds)), runs, pc.binary_join(left, " ")],
                    names=[*batch.schema.names[: 2 + keep], "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id``, ``text``, ``kept`` (a struct of the columns named in
    ``keep``, if any), ``n_words``, ``runs`` (start, length and period in words,
    ordered by start, then period) and ``collapsed``, the words that stay,
    joined by one space.

    Dropped is each word that some run contains after the run's first period.
    Words are parted by ASCII white space and compared by their bytes. NULL and
    empty texts have no words and no runs. Every row stands for itself, so
    repeated rows and NULL ids change nothing. Long texts are read whole: a
    task holds the arrays of one slice of 4 MB or, if longer, of one document,
    about 200 bytes a word that lies in a repeat. Columns not named in ``keep``
    are dropped, whatever their name. No rows give no rows.
    """
    src = texts(docs, id_col, text_col, keep)
    schema = StructType(src.schema.fields + StructType.fromDDL(
        "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").fields)
    return src.mapInArrow(_collapse(shortest, 1 if keep else 0), schema)


def longest_run(runs: Column) -> Column:
    """The run of the greatest length; of equal ones the first, then the one of
    the least period. NULL if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("over"))))
    return F.when(best.isNotNull(), F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["over"]).alias("period")))
