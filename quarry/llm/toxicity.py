"""Toxicity scores: a lexicon trie searched with Levenshtein automata, and the
context of each match.

The lexicon is learned from labelled documents: whole words and word beginnings
that are much more frequent in toxic ones. Its trie is intersected with the
automaton of one edit, as one deterministic automaton built as it is needed,
so a token costs one step per character until nothing can match any more. A
match is judged in its window of words: in quotation marks or after a word of
reporting it counts as quoted. A small logistic model over the matches' kinds
turns them into a score; it starts from stated weights and moves as far as the
labelled rows say.

Fitting uses at most FIT_ROWS labelled documents (chosen by hash of their id);
scoring reads every document and shuffles none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from quarry.llm.common import materialize, quoted, slices, texts

#: Labelled rows that the model is fitted on; bound of what is broadcast.
FIT_ROWS = 100_000
#: A term is a candidate if it is in this share of the toxic rows (and in
#: MIN_ROWS).
MIN_SHARE, MIN_ROWS = 0.002, 3
#: Up to this many candidates are broadcast, so that counting in all rows looks
#: only for them; more are counted with all other terms and joined.
CANDIDATES_SENT = 500_000
#: Least log odds ratio and least evidence (log likelihood ratio) of a term.
MIN_ODDS, MIN_EVIDENCE = 2.5, 8.0
#: Word beginnings considered as terms, in characters; a term's length from
#: which one plain edit is trusted by itself.
STEMS, LONG = range(4, 9), 8
#: Words on each side of a match that make its context.
CONTEXT = 6
#: Memory bounds of a task, without effect on results.
TOKENS_KEPT, STATES_KEPT, COUNTS_KEPT, SLICE_BYTES = 100_000, 20_000, 200_000, 2 << 20

#: Words that report what others say, and quotation marks.
REPORTING = frozenset("said says say word words term called quote quoted quotes wrote means insult slur mot terme dit wort begriff sagte palabra dijo".split())
OPEN_QUOTES, CLOSE_QUOTES = "\"“„«‹‘", "\"”“»›’"

_COMMON = ".,;:!?()[]{}\"'*%&$#|"
_ENDS = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")

EXACT, ODD, LONG_EDIT, SHORT_EDIT = range(4)
#: Stated weights of the features, in order: constant; best match of each kind
#: outside quotation; the same inside; matches in a hundred words.
PRIOR = np.array([-3.0, 7.0, 6.0, 4.0, 0.5, 1.5, 1.0, 0.5, 0.0, 0.2])


def token(raw: str) -> str:
    """A whitespace-separated word in lower case without outer punctuation."""
    word = raw.strip(_COMMON)
    if word and not (word[0].isalnum() and word[-1].isalnum()):
        word = _ENDS.sub("", word)
    return word.lower()


class Lexicon:
    """Terms with weights in (0, 1]; a term that ends in ``*`` is a beginning."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.open: list[str | None] = [None]  # the beginning that is complete here
        for t in sorted(terms):
            at = 0
            for c in t.removesuffix("*"):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.open.append(None)
                at = self.next[at][c]
            (self.open if t.endswith("*") else self.term)[at] = t
        self._begin()

    def _begin(self) -> None:
        """An automaton of its first state only; the others are built again as
        they are needed."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    def _close(self, items: set) -> frozenset:
        """With letters of terms left out of the token (one edit)."""
        items = set(items)
        for node, edits, kind in list(items):
            if not edits:
                items.update((to, 1, "p") for to in self.next[node].values())
        # a state with an edit adds nothing beside the same one without
        return frozenset(x for x in items if not (x[1] and (x[0], 0, "") in items))

    def _state(self, items: set) -> int:
        key = self._close(items)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        """One character read: followed exactly, replaced, or put in. The edit
        is "o" (odd: digit, symbol or repeated letter) or "p" (plain)."""
        out = set()
        for node, edits, kind in self.sets[state]:
            if node < 0:  # inside the free end of a beginning
                out.add((node, edits, kind))
                continue
            to = self.next[node].get(c)
            if to is not None:
                out.add((to, edits, kind))
            if self.open[node]:
                out.add((-1 - node, edits, kind))
            if not edits:
                odd = not c.isalpha()
                out.update((other, 1, "o" if odd else "p") for x, other in self.next[node].items() if x != c)
                out.add((node, 1, "o" if odd or self._repeats(node, c) else "p"))
        self.steps[state][c] = new = self._state(out)
        return new

    def _repeats(self, node: int, c: str) -> bool:
        """Whether every way to the node reads c last (its trie has one way)."""
        return node in self._last() and self._last()[node] == c

    def _last(self) -> dict[int, str]:
        if not hasattr(self, "_last_char"):
            self._last_char = {to: c for step in self.next for c, to in step.items()}
        return self._last_char

    def match(self, word: str) -> tuple[int, float] | None:
        """Kind and weight of the best match of a token."""
        if not word:
            return None
        if len(self.sets) > STATES_KEPT:
            self._begin()
        state = self.start
        for c in word:
            state = self.steps[state].get(c) if c in self.steps[state] else self._step(state, c)
            if not self.sets[state]:
                return None
        best = None
        for node, edits, kind in self.sets[state]:
            for t in {self.open[-1 - node]} if node < 0 else {self.term[node], self.open[node]}:
                if t is None:
                    continue
                n = len(t.removesuffix("*"))
                # an edited beginning or an edited short term says little
                if edits and (n < 4 or t.endswith("*") and n < LONG):
                    continue
                found = (EXACT if not edits else ODD if kind == "o" else LONG_EDIT if n >= LONG else SHORT_EDIT, self.terms[t])
                if best is None or (-found[0], found[1]) > (-best[0], best[1]):
                    best = found
        return best


class _Seen(dict):
    """Match of every raw word seen, found once."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str):
        if len(self) > TOKENS_KEPT:
            self.clear()
        self[raw] = m = self.lexicon.match(token(raw))
        return m


def _quoted(words: list[str], i: int) -> bool:
    """Whether word i stands in quotation marks or after a word of reporting."""
    before, after = words[max(0, i - CONTEXT) : i + 1], words[i : i + CONTEXT + 1]
    opened = any(w[0] in OPEN_QUOTES for w in before)
    closed = any(w.rstrip(".,;:!?)")[-1:] in CLOSE_QUOTES and w.rstrip(".,;:!?)") for w in after)
    return opened and closed or any(token(w) in REPORTING for w in before[:-1][-3:])


def features(words: list[str], seen: _Seen) -> list[float]:
    """The model's features of one text, given its words."""
    hits = [(i, m) for i, m in enumerate(map(seen.__getitem__, words)) if m]
    out = [1.0] + [0.0] * 9
    for i, (kind, weight) in hits:
        at = 1 + kind + 4 * _quoted(words, i)
        out[at] = max(out[at], weight)
    if hits:
        out[9] = min(5.0, 100 * len(hits) / len(words))
    return out


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    weights: tuple[float, ...]


def _document_terms(text: str) -> set[str]:
    words = {token(w) for w in set(text.split())}
    out = words - {""}
    out.update(w[:k] + "*" for w in words for k in STEMS if len(w) > k)
    return out


def _count_terms(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """Rows of each label that have a term, summed over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = shared.value, (Counter(), Counter())

        def flush():
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[t] for t in names], pa.int64()) for c in counts]], names=["term", "n0", "n1"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = _document_terms(text)
                counts[toxic].update(terms if wanted is None else terms & wanted)
                if len(counts[0]) + len(counts[1]) > COUNTS_KEPT:
                    yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "term string, n0 long, n1 long") \
        .groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _telling(rows0: int, rows1: int) -> Column:
    """Whether a term (``n0``, ``n1`` rows of each label) can be in the lexicon,
    with some room for rounding; ``choose_terms`` decides."""
    n0, n1 = F.col("n0"), F.col("n1")
    odds = F.log((n1 + 0.5) / (rows1 + 1)) - F.log((n0 + 0.5) / (rows0 + 1))
    return (n1 > n0) & (odds >= MIN_ODDS - 1e-6)


def choose_terms(counts: list[tuple[str, int, int]], rows0: int, rows1: int, most: int | None = None) -> dict[str, float]:
    """The lexicon: terms with enough odds and evidence, the best first; among
    terms that say the same the most specific one. What a chosen beginning
    covers is no evidence of its own and takes its weight, but stays for edited
    matches if the beginning is too short for them. ``most`` limits the terms,
    besides those under a chosen beginning (default: all)."""
    scored = []
    for t, n0, n1 in counts:
        odds = math.log((n1 + 0.5) / (rows1 + 1) / ((n0 + 0.5) / (rows0 + 1)))
        share, expected = n1 / (n0 + n1) if n0 + n1 else 0, rows1 / (rows0 + rows1)
        evidence = n1 * math.log(share / expected) + (n0 * math.log((1 - share) / (1 - expected)) if n0 else 0) if n1 else 0
        if odds >= MIN_ODDS and evidence >= MIN_EVIDENCE and n1 > n0:
            scored.append((n1 - 20 * n0, not t.endswith("*"), len(t), t, n1, odds))
    chosen: dict[str, float] = {}
    covered: dict[str, str] = {}  # terms under a chosen beginning, which they follow
    reach: dict[str, int] = {}  # rows of the best chosen term below each beginning
    top = max((s[5] for s in scored), default=1.0)
    for _, _, _, t, n1, odds in sorted(scored, key=lambda s: (-s[0], -s[1], -s[2], s[3])):
        body = t.removesuffix("*")
        over = next((body[:k] + "*" for k in range(1, len(body) + (not t.endswith("*"))) if body[:k] + "*" in chosen), None)
        if over:
            if len(over) <= LONG and (not t.endswith("*") or len(body) >= LONG):
                covered[t] = over
            continue
        if len(chosen) == most or t.endswith("*") and n1 <= 1.1 * reach.get(body, 0):
            continue
        chosen[t] = odds / top
        for k in range(1, len(body) + 1):
            reach[body[:k]] = max(reach.get(body[:k], 0), n1)
    return {t: chosen[over] for t, over in covered.items()} | chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights, held to ``prior`` with the given strength (Newton
    steps), for rows that occur ``times`` times."""
    def loss(w):
        z = x @ w
        return times @ (np.logaddexp(0, z) - y * z) + strength / 2 * ((w - prior) ** 2).sum()

    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - y)) + strength * (w - prior)
        hessian = (x * (times * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() >= 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _batch_features(column: pa.Array, seen: _Seen) -> list[list[float]]:
    """Features of each text. Arrow numbers the distinct words, which are
    matched once; only texts with a match are looked at word by word."""
    cut = pc.utf8_split_whitespace(column)
    bounds = cut.offsets.to_numpy()
    bounds = bounds - bounds[0]
    numbered = cut.flatten().dictionary_encode()
    number, distinct = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
    matched = np.fromiter((seen[w] is not None for w in distinct), bool, len(distinct))
    before = np.append(0, np.cumsum(matched[number]))[bounds]
    blank = features([], seen)
    return [
        features([distinct[n] for n in number[i:j].tolist() if distinct[n]], seen) if hits else blank
        for i, j, hits in zip(bounds.tolist(), bounds[1:].tolist(), np.diff(before).tolist())
    ]


def _features(rows: DataFrame, terms: dict[str, float], extra: list[str], inside: int | None = None) -> DataFrame:
    """``extra`` columns, then the features of column ``text`` or, so that no
    text goes to the task twice, of that field of the struct ``kept``."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    src = rows.select(F.lit(0).alias("_"), F.col("text") if inside is None else F.lit("").alias("text"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(Lexicon(shared.value))
        for whole in batches:
            if inside is not None:
                text = pc.struct_field(whole.column(whole.schema.get_field_index("kept")), [inside])
                whole = whole.set_column(1, "text", pc.fill_null(text, "") if text.null_count else text)
            for batch in slices(whole, SLICE_BYTES):
                f = _batch_features(batch.column(1), seen)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(2, batch.num_columns)] + [pa.array(f, pa.list_(pa.float64()))],
                                                 names=[*extra, "f"])

    return src.mapInArrow(run, StructType(src.schema.fields[2:]).add("f", ArrayType(DoubleType())))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS, most_terms: int | None = None) -> Model:
    """Learn a model from the labelled rows that are not held out.

    NULL labels, labels other than 0 and 1 and labels without a document are
    left out; a document with both labels counts once for each. Of documents
    with one id but different texts one counts, chosen by a hash; equal rows
    count each. Terms have any length, and the lexicon all terms that tell
    enough (``most_terms`` limits them). Without a single row of each label the
    lexicon is empty and the stated weights hold. Long texts are read whole;
    other columns do not matter, whatever their name.
    """
    src = texts(docs, id_col, text_col)
    marks = labels.select(F.col(quoted("doc_id")).cast("long").alias("id"), F.col(quoted(label_col)).cast("int").alias("toxic")) \
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    marks = marks.orderBy(F.xxhash64("id", "toxic")).limit(fit_rows)
    hashed = src.withColumn("h", F.xxhash64("text"))
    # so there are at most fit_rows different labelled rows, which bounds what is collected below
    one = hashed.select("doc_id", "h").join(F.broadcast(marks), F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(F.min("h").alias("of"))
    rows = hashed.join(F.broadcast(one), (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("of"))).select("text", "toxic")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, tuple(PRIOR))
    least = max(MIN_ROWS, math.ceil(MIN_SHARE * n[1]))
    found = materialize(_count_terms(rows.where("toxic = 1"), None).where(F.col("n1") >= least).select("term", "n1"), "terms")
    if found.count() <= CANDIDATES_SENT:
        counts = _count_terms(rows, frozenset(r.term for r in found.select("term").collect()))
    else:
        counts = found.join(_count_terms(rows.where("toxic = 0"), None).select("term", "n0"), "term", "left").select("term", F.coalesce("n0", F.lit(0)).alias("n0"), "n1")
    telling = counts.where(_telling(n[0], n[1])).select("term", "n0", "n1").collect()
    terms = choose_terms([tuple(r) for r in telling], n[0], n[1], most_terms)
    kinds = _features(rows, terms, ["toxic"]).groupBy("f", "toxic").count().orderBy(F.desc("count"), "toxic", "f").collect()
    x, y, times = np.array([r.f for r in kinds]), np.array([r.toxic for r in kinds], float), np.array([r["count"] for r in kinds], float)
    w = fit_logistic(x, y, times)
    return Model(terms, tuple(float(v) for v in w))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's ``doc_id``, ``kept`` (see ``texts``; if asked for) and
    ``score`` between 0 and 1. NULL and empty texts score as texts without a
    match; repeated rows keep one row each; no rows give no rows. Long texts are
    read whole, each in one task. Columns not in ``keep`` do not matter,
    whatever their name."""
    src = texts(docs, id_col, text_col, keep)
    extra = [c for c in src.columns if c != "text"]
    inside = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType == StringType() else None
    total = sum((F.col("f")[i] * F.lit(w) for i, w in enumerate(model.weights)), F.lit(0.0))
    return _features(src, model.terms, extra, inside).select(*extra, (1 / (1 + F.exp(-total))).alias("score"))
