"""Pseudo-likelihood scores against a plain computation, and learning."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm import lm_score as lm
from quarry.llm.hashing import batch_hashes
from tests.llm.helpers import prose

SCHEMA = "doc_id long, text string, log_prob string"


def corpus():
    rng = random.Random(3)
    order = "the old man saw a red fox near my house and ran to it".split()
    rows = [(i, " ".join(order * rng.randint(2, 6))) for i in range(150)]
    rows += [(200 + i, prose(rng, rng.randint(1, 60))) for i in range(60)]
    return rows + [(300, None), (301, ""), (302, "one"), (None, "The old man"), (3, rows[3][1]), (303, "far " * 20_000)]


def plain(net, text):
    c = net.class_of(batch_hashes(pa.array([text or ""]), lower=True)[0])
    padded = [lm.EDGE] * lm.SIDE + c.tolist() + [lm.EDGE] * lm.SIDE
    total = 0.0
    for i in range(len(c)):
        around = padded[i : i + lm.SIDE] + padded[i + lm.SIDE + 1 : i + 2 * lm.SIDE + 1]
        hidden = np.tanh(sum(net.tables[k, w].astype(float) for k, w in enumerate(around)))
        logits = hidden @ net.out + net.bias
        total += logits[c[i]] - np.log(np.exp(logits).sum())
    return total


def test_scores(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    net = lm.fit(df, rounds=6)
    out = lm.score(df, net).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for doc_id, text in rows[::9] + rows[-6:-1]:
        r = by_id[doc_id]
        assert r.n_tokens == len((text or "").split()) and math.isclose(r.log_prob, plain(net, text), rel_tol=1e-3, abs_tol=1e-3)
    assert by_id[300].log_prob == by_id[301].log_prob == 0 and by_id[300].per_token is None
    # training beats the frequencies, and word order matters
    first = lm.fit(df, rounds=0)
    before = {r.doc_id: r.log_prob for r in lm.score(df, first).collect()}
    assert sum(r.log_prob for r in out) > sum(before[r.doc_id] for r in out) + 100
    text = rows[0][1].split()
    mixed = " ".join(random.Random(1).sample(text, len(text)))
    assert plain(net, " ".join(text)) > plain(net, mixed)


def test_gradient():
    rng = np.random.default_rng(2)
    net = lm.start([(int(w), 5) for w in rng.integers(0, 1 << 60, lm.HEAD)], {k: 1000 for k in range(lm.HASHED)})
    row, at = lm.contexts(rng.integers(0, lm.CLASSES, 80), np.array([0, 50, 50, 80]))
    before = lm.log_probs(net, row, at).mean()
    trainer = lm.Trainer(net)
    for _ in range(20):
        trainer.step(row, at)
    assert lm.log_probs(trainer.net, row, at).mean() > before + 0.5


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lm.score(df, lm.fit(df)).count() == 0


def test_word_given_class(spark):
    rows = [r for r in corpus() if r[0] != 303]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    counts = lm.word_counts(df)
    net = lm.fit(df, rounds=1, counts=counts)
    known = Counter(w.lower() for _, t in rows for w in (t or "").split())
    hashed = {w: int(batch_hashes(pa.array([w]))[0][0]) for w in known}
    head = set(net.words.tolist())
    total = Counter()
    for w, n in known.items():
        total[hashed[w] % lm.HASHED] += n * (hashed[w] not in head)
    inside = lambda w: 0 if hashed[w] in head else math.log(known[w] / (total[hashed[w] % lm.HASHED] + 1))
    assert any(n > 1 and inside(w) for w, n in known.items())
    classes, whole, joined = (sorted(lm.score(df, net, **k).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
                              for k in ({}, {"counts": counts}, {"counts": counts, "common": 0}))
    assert len(classes) == len(whole) == len(joined) == len(rows)
    for a, b, c, (_, text) in zip(classes, whole, joined, sorted(rows, key=lambda r: (r[0] or -1, len((r[1] or "").split())))):
        assert a.doc_id == b.doc_id == c.doc_id and a.n_tokens == b.n_tokens == c.n_tokens == len((text or "").split())
        want = a.log_prob + sum(inside(w.lower()) for w in (text or "").split())
        assert math.isclose(b.log_prob, want, rel_tol=1e-6, abs_tol=1e-6) and math.isclose(c.log_prob, want, rel_tol=1e-6, abs_tol=1e-6)
    # the word's own count tells apart two words of one class
    one, two = next((v, w) for v in known for w in known if inside(v) and inside(w) and known[v] != known[w] and hashed[v] % lm.HASHED == hashed[w] % lm.HASHED)
    pair = spark.createDataFrame([(1, one, "x"), (2, two, "x"), (3, "neverseen", "x")], SCHEMA)
    got = {r.doc_id: r.log_prob for r in lm.score(pair, net, counts=counts).collect()}
    assert math.isclose(got[1] - got[2], math.log(known[one] / known[two]), abs_tol=1e-6) and math.isfinite(got[3])


def test_every_word_is_a_target_once(spark):
    rng = np.random.default_rng(4)
    bounds = np.append(0, np.cumsum([0, 1, 1, 1, 5, 9, 0, 400, 1, 0]))
    words = rng.integers(0, 1 << 63, bounds[-1]).astype(np.uint64)
    for rounds in (1, 2, 3, 6):
        shares = [lm.masked(words, bounds, turn, rounds) for turn in range(rounds)]
        assert sorted(np.concatenate(shares).tolist()) == list(range(bounds[-1]))
        long = [int(((s >= 17) & (s < 417)).sum()) for s in shares]
        assert max(long) - min(long) <= 10
    # a text's shares do not depend on the texts around it
    alone = lm.masked(words[8:17], np.array([0, 9]), 0, 2) + 8
    assert alone.tolist() == [k for k in lm.masked(words, bounds, 0, 2).tolist() if 8 <= k < 17]
    # the tasks of all rounds train on all words of all documents
    seen = []
    df = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "x") for i in range(60)], SCHEMA)
    taken = df.select("doc_id", "text")
    net = lm.fit(df, rounds=0)
    for turn in range(lm.ROUNDS):
        out = taken.mapInArrow(lm._train(spark.sparkContext.broadcast(net), turn, lm.ROUNDS), "chunk int, part int, seen long, total array<double>")
        seen.append(sum(r.seen for r in out.where("chunk = 0").collect()))
    assert sum(seen) == sum(1 + i % 7 for i in range(60)) and all(seen)


def test_average_as_a_tree(spark, monkeypatch):
    """Sums of sums, whatever the number of tasks."""
    monkeypatch.setattr(lm, "FAN", 3)
    rows = [(c, part, part + 1, [float(part * (c + 1)), 1.0]) for c in range(2) for part in range(20)]
    got = {r.chunk: r["mean"] for r in lm._average(spark.createDataFrame(rows, lm.COPY), 20).collect()}
    assert got == {c: [sum(p * (c + 1) for p in range(20)) / 210, 20 / 210] for c in range(2)}
