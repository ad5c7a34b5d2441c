"""Benchmark decontamination with suffix arrays over the training text.

Every slice of documents that a task reads is a shard. Its words become ids of
the benchmark's vocabulary (0: not in it), and a suffix array is built over the
positions where a benchmark window could start at all, that is where enough
benchmark words follow one another. Every test suffix is binary-searched in
the array; matches on one diagonal join to longest verbatim matches. Nothing
is shuffled.

The benchmark is broadcast in blocks of at most BLOCK_BYTES of text, with one
pass over the documents for each block, so a large benchmark costs passes and
not memory.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import materialize, quoted, slices, texts

#: Words of a window, most benchmark text in one broadcast, text of a shard.
WINDOW = 13
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20

#: Bytes that part words, as in [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"
HITS = f"n_words long, spans array<struct<start:int,stop:int>>, items array<string>, matches {_MATCH}"


def _words(text: str) -> list[bytes]:
    """Lower-cased words, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class TestSuffixes:
    """The windows of a block of benchmark items, as sorted distinct keys of
    word ids. A window of fewer words is its own prefix search."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names, parts, size = [], [], []
        for name, text in items:
            words = _words(text)
            if words:
                known = self.vocab
                parts.append(np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int32, len(words)))
                self.names.append(name)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate([*parts, np.zeros(window, np.int32)])
        del parts
        ends = np.cumsum(size)
        windows = np.maximum(size - window, 0) + 1  # of each item
        self.item = np.repeat(np.arange(len(size), dtype=np.int32), windows)
        self.start = (np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        begin = (ends - size)[self.item] + self.start
        length = np.minimum(size, window)[self.item].astype(np.int16)
        keys = np.empty(len(begin), f"S{4 * window}")
        column = np.arange(window)
        for lo in range(0, len(begin), 1 << 16):
            rows = flat[begin[lo : lo + (1 << 16), None] + column]
            rows[column >= length[lo : lo + (1 << 16), None]] = 0
            keys[lo : lo + (1 << 16)] = _keys(rows)
        # equal windows are searched once; `of` lists the windows of each key
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        self.low, self.of, self.bounds = keys[new], order, np.append(np.flatnonzero(new), len(keys))
        self.length = length[order][new].astype(np.int64)
        self.shortest = int(self.length.min()) if len(self.low) else window
        self.short = np.flatnonzero(self.length < window)
        rows = np.frombuffer(self.low[self.short].tobytes(), ">u4").reshape(-1, window).astype(np.int64)
        self.short_first = np.zeros(len(self.vocab) + 1, bool)
        self.short_first[rows[:, 0]] = True
        rows[np.arange(len(rows)), self.length[self.short] - 1] += 1
        self.short_high = _keys(rows)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(seq: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window keys and their positions, over the positions of ``seq``
    at which a window of the benchmark can start. 0 in ``seq`` ends a match."""
    zero = np.append(np.flatnonzero(seq == 0), len(seq))
    stop = zero[np.searchsorted(zero, np.arange(len(seq)))]
    run = stop - np.arange(len(seq))
    at = np.flatnonzero((run >= test.window) | ((run >= test.shortest) & test.short_first[seq]))
    column = np.arange(test.window)
    rows = np.append(seq, np.zeros(test.window, seq.dtype))[at[:, None] + column]
    rows[column >= run[at][:, None]] = 0
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def search(keys: np.ndarray, at: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """All (distinct test window, position) pairs that agree over the window."""
    lo, hi = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.low, "right")
    hi[test.short] = np.searchsorted(keys, test.short_high, "left")
    n = hi - lo
    found = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
    return found, at[np.repeat(lo, n) + offset]


def _windows_of(key: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the benchmark that have each key, and the place of the key."""
    n = test.bounds[key + 1] - test.bounds[key]
    row = np.repeat(np.arange(len(key)), n)
    return test.of[np.repeat(test.bounds[key], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)], row


def longest(key: np.ndarray, at: np.ndarray, test: TestSuffixes) -> np.ndarray:
    """Rows (item, item_start, position, n_words): matches that follow one
    another on a diagonal of one item make one longest match."""
    if not len(key):
        return np.empty((0, 4), np.int64)
    suffix, row = _windows_of(key, test)
    item, start, size, at = test.item[suffix].astype(np.int64), test.start[suffix].astype(np.int64), test.length[key][row], at[row]
    order = np.lexsort((start, at - start, item))
    item, start, at, size = item[order], start[order], at[order], size[order]
    first = np.r_[True, (np.diff(item) != 0) | (np.diff(at - start) != 0) | (np.diff(start) != 1)]
    head = np.flatnonzero(first)
    tail = np.append(head[1:], len(item)) - 1
    return np.stack([item[head], start[head], at[head], start[tail] - start[head] + size[tail]], axis=1)


def _shard(docs: list[str], test: TestSuffixes, matches: bool) -> list[tuple]:
    """(n_words, spans, items, matches) of every document of one shard."""
    split = [_words(t) for t in docs]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    begin = np.cumsum(n_words + 1) - (n_words + 1)
    seq = np.zeros(int((n_words + 1).sum()), np.int32)
    for b, words in zip(begin.tolist(), split):
        seq[b : b + len(words)] = np.fromiter(map(test.vocab.get, words, repeat(0)), np.int32, len(words))
    out = [(n, [], [], []) for n in n_words.tolist()]
    if not len(test.low) or not len(seq):
        return out
    key, at = search(*suffix_array(seq, test), test)
    # words inside occurrences, each once whatever the number of items
    edge = np.zeros(len(seq) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + test.length[key], 1)
    inside = np.diff(np.r_[0, (np.cumsum(edge) > 0).astype(np.int8)])
    starts, stops = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    for d, s, e in zip((np.searchsorted(begin, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist()):
        out[d][1].append((s - int(begin[d]), e - int(begin[d])))
    # a key counts once for a document, with all items that have it
    doc = np.searchsorted(begin, at, "right") - 1
    pair = np.unique(doc * len(test.low) + key)
    window, row = _windows_of(pair % len(test.low), test)
    pair = np.unique((pair // len(test.low))[row] * len(test.names) + test.item[window])
    for d, i in zip((pair // len(test.names)).tolist(), (pair % len(test.names)).tolist()):
        out[d][2].append(test.names[i])
    if matches:
        found = longest(key, at, test)
        doc = np.searchsorted(begin, found[:, 2], "right") - 1
        for d, (item, start, place, n) in sorted(zip(doc.tolist(), found.tolist()), key=lambda x: (x[0], x[1][2], x[1][3])):
            out[d][3].append((test.names[item], start, place - int(begin[d]), n))
    return [(n, spans, sorted(set(names)), m) for n, spans, names, m in out]


def _merge(a: tuple, spans, items, matches) -> tuple:
    """Hits of another block added to those of a document."""
    merged: list[tuple] = []
    for s, e in sorted([*a[1], *((x["start"], x["stop"]) for x in spans)]):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    more = [tuple(m[k] for k in ("item_id", "item_start", "doc_start", "n_words")) for m in matches]
    return a[0], merged, sorted({*a[2], *items}), a[3] + more


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))
_KINDS = {"n_words": pa.int64(), "spans": _SPANS, "items": pa.list_(pa.string()), "matches": _MATCHES}


#: The suffixes of the block that this worker has seen last; its tasks share them.
_BUILT: dict[str, TestSuffixes] = {}


def built(block: str, shared, window: int) -> TestSuffixes:
    if block not in _BUILT:
        _BUILT.clear()
        _BUILT[block] = TestSuffixes(shared.value, window)
    return _BUILT[block]


def _pass(docs: DataFrame, items: list[tuple[str, str]], window: int, matches: bool) -> DataFrame:
    """One pass over the documents with one block of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    block = uuid.uuid4().hex
    earlier = "spans" in docs.columns
    own = [f for f in docs.schema.fields if f.name not in _KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = built(block, shared, window)
        for whole in batches:
            for batch in slices(whole, SHARD_BYTES):
                rows = _shard(batch.column(1).to_pylist(), test, matches)
                if earlier:
                    old = batch.select(["spans", "items", "matches"]).to_pylist()
                    rows = [_merge(r, **o) for r, o in zip(rows, old)]
                cells = list(zip(*[(n, [{"start": s, "stop": e} for s, e in spans], names,
                                    [dict(zip(("item_id", "item_start", "doc_start", "n_words"), m)) for m in found])
                                   for n, spans, names, found in rows]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(own))] + [pa.array(c, k) for c, k in zip(cells, _KINDS.values())],
                    names=[f.name for f in own] + list(_KINDS))

    return docs.mapInArrow(run, StructType(own + StructType.fromDDL(HITS).fields))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       keep: tuple[str, ...] = (), matches: bool = True) -> DataFrame:
    """Per document ``doc_id``, ``text``, ``kept`` (a struct of the columns
    named in ``keep``, if any), ``n_words``, ``spans`` (word ranges
    inside occurrences of benchmark windows, merged), ``items`` (ids of items
    with such windows, sorted as strings) and ``matches`` (longest verbatim
    matches with their places in item and document; empty without ``matches``,
    which lists every item at every occurrence).

    A window is ``window`` words of an item; an item of fewer words is one
    window, an item without words has none. NULL texts have no words (and come
    back empty). Repeated documents keep one row each; items that share an id
    count as one; an item without an id is named ``null``. An empty benchmark
    or table gives no hits or no rows. Long texts are read whole: a task holds a
    shard of 8 MB or one text. Columns not in ``keep`` are dropped, whatever
    their name.
    """
    src = texts(docs, id_col, text_col, keep)
    bench = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("null")).alias("item_id"), F.col(quoted(item_text_col)).cast("string").alias("text")) \
        .where("text IS NOT NULL").distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(blocks):
        items = [(r.item_id, r.text) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        if block:
            src = materialize(src, "contamination")
        src = _pass(src, sorted(items), window, matches)
    return src


def n_hit(spans) -> F.Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated(n_words, hit) -> F.Column:
    """The rule: some word is hit, and at least a twentieth of all words."""
    return (hit > 0) & (20 * hit >= n_words)
