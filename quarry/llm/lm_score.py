"""Language-model scores: masked pseudo-likelihood of a bidirectional window
network.

Words are mapped to classes: the most frequent words of the whole corpus each
have one, all others share hashed classes. The network predicts the class of a
word from SIDE words on either side: each place has its own embedding table,
their sum goes through tanh and a softmax layer. A document's score is the sum
of the conditional log-probabilities of all its words. A word is P(class | both
sides) * P(word | class); the second factor is the word's share of its hashed
class in the whole corpus (1 for a frequent word).

Counts are taken over every document and summed by Spark; they are a written
table that grows with the corpus. The words with the highest counts go out by
broadcast, up to a fixed number; all others are joined with the table. Training goes over
every document too, and over every word: the rounds share out the positions of each document,
so that each is predicted in one round. In a round every task trains a copy of
the network, in numpy, on its documents' positions of that round, and the
copies are averaged, weighted by the words they have seen. What the driver
gets is the vocabulary's head and one averaged network, both of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, slices, texts
from quarry.llm.hashing import ODD, batch_words, mix

#: Classes of frequent words, hashed classes of all others, words on each side,
#: size of the embeddings.
HEAD, HASHED, SIDE, WIDTH = 128, 64, 3, 16
#: Rounds over the corpus, words of a training step, learning rate, bound on
#: the weights.
ROUNDS, STEP, RATE, BOUND = 2, 256, 0.1, 3.0
#: Memory bounds of a task: text and words handled at once.
SLICE_BYTES, COUNT_AT_ONCE, SCORE_AT_ONCE = 8 << 20, 4_000_000, 16_384
#: Most words whose counts are broadcast, without effect on results.
COMMON = 1 << 18
#: Network values in one row on their way to the average, and most rows that
#: are summed at once.
CHUNK, FAN = 512, 1024
COPY = "chunk int, part int, seen long, total array<double>"

CLASSES = HEAD + HASHED
EDGE = CLASSES  # what stands before and after a text


@dataclass
class Network:
    """``tables`` (2 * SIDE, CLASSES + 1, WIDTH), ``out`` (WIDTH, CLASSES) and
    ``bias`` (CLASSES); ``words`` are the sorted hashes of the frequent words
    and ``classes`` their classes."""

    words: np.ndarray
    classes: np.ndarray
    tables: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def class_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return (HEAD + hashes % np.uint64(HASHED)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.classes[at], HEAD + (hashes % np.uint64(HASHED)).astype(np.int64))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.tables.ravel(), self.out.ravel(), self.bias]).astype(np.float32)

    def with_flat(self, x: np.ndarray) -> Network:
        a, b = self.tables.size, self.tables.size + self.out.size
        x = x.astype(np.float32)
        return Network(self.words, self.classes, x[:a].reshape(self.tables.shape).copy(), x[a:b].reshape(self.out.shape).copy(), x[b:].copy())


def start(head: list[tuple[int, int]], buckets: dict[int, int]) -> Network:
    """A network that predicts the corpus frequencies: small fixed tables and
    biases from the counts of the frequent words and the hashed classes."""
    words = np.array([w for w, _ in head], np.int64).view(np.uint64)
    counts = np.ones(CLASSES)
    for k, (w, n) in enumerate(head):
        counts[k] += n
        buckets[w % HASHED if w >= 0 else (w + (1 << 64)) % HASHED] -= n
    for k, n in buckets.items():
        counts[HEAD + k] += n
    order = np.argsort(words)
    rng = np.random.default_rng(0)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Network(words[order], np.arange(len(words))[order], small(2 * SIDE, CLASSES + 1, WIDTH), small(WIDTH, CLASSES),
                   np.log(counts / counts.sum()).astype(np.float32))


def contexts(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts in a row, with edges between, and the
    positions of the words."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(classes)) + SIDE * (text + 1)
    row = np.full(len(classes) + SIDE * len(bounds), EDGE)
    row[at] = classes
    return row, at


_PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def log_probs(net: Network, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the word at each position, given both sides."""
    hidden = np.zeros((len(at), WIDTH), np.float32)
    for table, d in zip(net.tables, _PLACES):
        hidden += table.take(row.take(at + d), axis=0)
    logits = np.tanh(hidden, out=hidden) @ net.out
    logits += net.bias
    own = logits[np.arange(len(at)), row[at]]
    # weights are bounded, so the exponentials need no shift
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


class Trainer:
    """Adagrad steps on a copy of a network."""

    def __init__(self, net: Network):
        self.net = net.with_flat(net.flat())
        self.squares = [np.full_like(x, 1e-2) for x in (self.net.tables, self.net.out, self.net.bias)]

    def _move(self, k: int, weights: np.ndarray, gradient: np.ndarray, bound: float) -> None:
        self.squares[k] += gradient**2
        weights -= RATE * gradient / np.sqrt(self.squares[k])
        np.clip(weights, -bound, bound, out=weights)

    def step(self, row: np.ndarray, at: np.ndarray) -> None:
        net, n = self.net, len(at)
        k = len(_PLACES)
        near = np.concatenate([row.take(at + d) + i * (CLASSES + 1) for i, d in enumerate(_PLACES)])
        hidden = net.tables.reshape(-1, WIDTH).take(near, axis=0).reshape(k, n, WIDTH).sum(axis=0)
        np.tanh(hidden, out=hidden)
        error = hidden @ net.out
        error += net.bias
        np.exp(error, out=error)
        error *= (1 / n / error.sum(axis=1, keepdims=True)).astype(np.float32)
        error[np.arange(n), row[at]] -= np.float32(1 / n)
        back = (error @ net.out.T) * (1 - hidden**2)
        cells = (near[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        tables = np.bincount(cells, np.concatenate([back] * k).ravel(), net.tables.size).astype(np.float32).reshape(net.tables.shape)
        self._move(1, net.out, hidden.T @ error, BOUND)
        self._move(2, net.bias, error.sum(axis=0), 10.0)
        self._move(0, net.tables, tables, BOUND)


def masked(words: np.ndarray, bounds: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Words masked for training in a round: an even share of every text, evenly
    spread. Every word is masked in exactly one round, whatever the order of the
    rows: a text's shares start at a place that follows from its words' hashes."""
    sums = np.append(np.uint64(0), np.cumsum(words, dtype=np.uint64))[bounds]
    first = mix(sums[1:] - sums[:-1])
    length = np.diff(bounds)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
    spread = (np.repeat(first, length) + place.astype(np.uint64)) * ODD[0] >> np.uint64(32)
    return np.flatnonzero(spread * np.uint64(rounds) >> np.uint64(32) == np.uint64(turn))


def _count_words():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            count = np.bincount(at, np.concatenate([c for _, c in held]), len(word)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])

        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                hashes, number, _ = batch_words(batch.column(1), lower=True)
                count = np.bincount(number, minlength=len(hashes))
                held.append((hashes[count > 0], count[count > 0]))
                n += len(held[-1][0])
                if n > COUNT_AT_ONCE:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How often each word of the corpus occurs: ``word`` (its hash) and ``n``,
    written once and read by fitting and scoring."""
    src = texts(docs, id_col, text_col)
    return materialize(src.mapInArrow(_count_words(), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _bucket() -> Column:
    """The hashed class of column ``word``, whose hash is unsigned."""
    return F.pmod(F.pmod(F.col("word"), F.lit(HASHED)) + HASHED, F.lit(HASHED))


def _train(net, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = net.value
        trainer, seen = Trainer(base), 0
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                hashes, number, bounds = batch_words(batch.column(1), lower=True)
                row, at = contexts(base.class_of(hashes)[number], bounds)
                chosen = at[masked(hashes[number], bounds, turn, rounds)]
                for i in range(0, len(chosen), STEP):
                    trainer.step(row, chosen[i : i + STEP])
                seen += len(chosen)
        if seen:
            flat = trainer.net.flat().astype(float) * seen
            parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            k, part = len(parts), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([seen] * k, pa.int64()),
                                              pa.array(parts, pa.list_(pa.float64()))], names=["chunk", "part", "seen", "total"])

    return run


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum of one chunk over some tasks, in the order of the tasks."""
    rows = rows.sort_values("part")
    return pd.DataFrame({"chunk": rows.chunk.iloc[:1], "part": rows.part.iloc[:1], "seen": [rows.seen.sum()], "total": [sum(np.asarray(x) for x in rows.total)]})


def _average(copies: DataFrame, tasks: int) -> DataFrame:
    """Weighted mean of each chunk over all tasks, as a tree: no group has more
    than ``FAN`` rows, however many tasks there are."""
    while tasks > FAN:
        copies = copies.withColumn("some", F.floor(F.col("part") / FAN).cast("int")).groupBy("chunk", "some").applyInPandas(_sum, COPY) \
            .withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        tasks = -(-tasks // FAN)
    whole = copies.groupBy("chunk").applyInPandas(_sum, COPY)
    return whole.select("chunk", F.transform("total", lambda x: x / F.col("seen")).alias("mean"))


def fit(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> Network:
    """Train a network on all documents, whole texts of any length. Without
    words it stays at its start. ``counts`` are their ``word_counts``, which are
    made if not given. NULL texts have no words, repeated rows count each; other
    columns do not matter, whatever their name."""
    src = texts(docs, id_col, text_col)
    sc = src.sparkSession.sparkContext
    if counts is None:
        counts = word_counts(docs, id_col, text_col)
    # the head keeps the HEAD most frequent words; the rest is summed by class
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD)
    both = counts.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n"))
    rows = top.select(F.lit(0).alias("kind"), F.col("word").alias("k"), "n").unionAll(both.select(F.lit(1), "bucket", "n")).collect()
    head = sorted(((r.k, r.n) for r in rows if r.kind == 0), key=lambda x: (-x[1], x[0]))
    net = start(head, {k: 0 for k in range(HASHED)} | {r.k: r.n for r in rows if r.kind == 1})
    for turn in range(rounds):
        copies = src.mapInArrow(_train(sc.broadcast(net), turn, rounds), COPY)
        means = _average(copies, src.rdd.getNumPartitions()).collect()
        if means:
            net = net.with_flat(np.concatenate([np.array(r["mean"]) for r in sorted(means, key=lambda r: r.chunk)]))
    return net


def _common(tail: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the words with the highest counts, and the counts:
    all words from the least power of two that at most ``most`` words reach."""
    power = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = {r.power: r["count"] for r in tail.groupBy(power.alias("power")).count().collect()}
    least = max(sizes, default=0) + 1
    while least and sum(k for p, k in sizes.items() if p >= least - 1) <= most:
        least -= 1
    rows = tail.where(F.col("n") >= 1 << least).select("word", "n").toArrow()
    word, n = (rows.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(word.view(np.uint64))
    return word.view(np.uint64)[order], n[order]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None,
          common: int = COMMON) -> DataFrame:
    """Per document ``doc_id``, ``n_tokens``, ``log_prob`` (sum over all words)
    and ``per_token``. NULL and empty texts have no words, a sum of 0 and a
    NULL mean. Repeated rows keep one row each; no rows give no rows.

    With the ``word_counts`` of the corpus, ``log_prob`` is that of the words;
    without, of their classes alone. A hashed class of N words leaves a share
    of 1 / (N + 1) to words that the corpus does not have. Long texts are read
    whole, each in one task; other columns do not matter, whatever their name.
    """
    src = texts(docs, id_col, text_col)
    sc = src.sparkSession.sparkContext
    whole_words = counts is not None
    known, logs, totals = np.empty(0, np.uint64), np.empty(0), np.zeros(CLASSES)
    if whole_words:
        tail = counts.where(~F.col("word").isin(net.words.view(np.int64).tolist()))
        for r in tail.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n")).collect():
            totals[HEAD + r.bucket] = np.log(r.n + 1)
        known, n = _common(tail, common)
        logs = np.log(n)
    shared = sc.broadcast((net, known, logs, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, known, logs, totals = shared.value
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                hashes, number, ends = batch_words(batch.column(1), lower=True)
                classes = model.class_of(hashes)
                row, at = contexts(classes[number], ends)
                each = [log_probs(model, row, at[i : i + SCORE_AT_ONCE]) for i in range(0, len(at), SCORE_AT_ONCE)]
                each = np.concatenate(each).astype(float) if each else np.empty(0)
                rare = np.zeros(len(hashes), bool)
                if whole_words:
                    inside = -totals[classes]
                    rare = classes >= HEAD
                    if len(known):
                        spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        found = rare & (known[spot] == hashes)
                        inside[found] += logs[spot[found]]
                        rare &= ~found
                    each += inside[number]
                sums = np.concatenate([[0.0], np.cumsum(each)])
                # the other words of each text, each with how often it occurs
                left = np.flatnonzero(rare[number])
                pair = np.searchsorted(ends, left, side="right") - 1
                pair, times = np.unique(pair * len(hashes) + number[left], return_counts=True)
                text, word = np.divmod(pair, max(len(hashes), 1))
                words = pa.StructArray.from_arrays([pa.array(hashes[word].view(np.int64)), pa.array(times)], names=["word", "times"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32()), words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + batch.num_rows)), batch.column(0), pa.array(np.diff(ends)), pa.array(sums[ends[1:]] - sums[ends[:-1]]), lists],
                    names=["row", "doc_id", "n_tokens", "log_prob", "rare"])
                key += batch.num_rows

    out = src.mapInArrow(run, "row long, doc_id long, n_tokens long, log_prob double, rare array<struct<word:long,times:long>>")
    if whole_words:
        # written, so that a row's number is the same for its sum and its words
        out = materialize(out, "word-scores")
        pairs = out.select("row", F.inline("rare")).join(tail, "word", "left")
        parts = pairs.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"),
                             (F.col("times") * F.log(F.coalesce("n", F.lit(1)))).alias("log_prob"))
        out = out.drop("rare").unionByName(parts).groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("log_prob").alias("log_prob"))
    return out.select("doc_id", "n_tokens", "log_prob").withColumn(
        "per_token", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
