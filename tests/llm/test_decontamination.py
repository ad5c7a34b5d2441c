"""Benchmark hits against all windows."""

import random
import re

import numpy as np
from quarry.llm import decontamination as dc
from tests.llm.helpers import prose

DOCS, ITEMS = "doc_id long, text string, spans string", "item_id long, text string, n_words int"


def words(text):
    """The contract's words, by its own pattern."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(docs, items, window):
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for name, item in items:
            w = words(item)
            m = min(window, len(w))
            wins = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
            for i in range(len(own) - m + 1 if m else 0):
                if tuple(own[i : i + m]) in wins:
                    hit.update(range(i, i + m))
                    names.add("null" if name is None else str(name))
        out.append((str(doc_id), len(own), len(hit), sorted(names)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(3, 40))) for i in range(12)] + [(20, "ka ka ka"), (21, None), (22, "!?"), (None, prose(rng, 15)), (3, prose(rng, 14))]
    docs = []
    for i in range(80):
        w = rng.choice(items)[1] or ""
        cut = w.split()[rng.randint(0, 3) :]
        docs.append((i, f"{prose(rng, rng.randint(0, 60))}, {' '.join(cut).upper()}! {prose(rng, rng.randint(0, 60))} {rng.choice(['', 'Ka ka: ka KA'])}"))
    docs += [(100, None), (101, ""), (102, "... !"), (7, docs[7][1]), (7, docs[7][1]), (None, docs[8][1]), (103, ("ka " * 20_000)), (104, "café 12 x")]
    return docs, items


def check(spark, docs, items):
    out = dc.find_contamination(spark.createDataFrame([(*d, "x") for d in docs], DOCS),
                                spark.createDataFrame([(*i, 1) for i in items], ITEMS), keep=("spans",))
    hit = dc.n_hit(out.spans)
    rows = out.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans", "matches", "kept").collect()
    assert sorted([(str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in rows], key=str) == brute_force(docs, items, dc.WINDOW)
    return rows


def test_against_all_windows(spark):
    docs, items = tables()
    rows = check(spark, docs, items)
    by_id = {}
    for name, text in items:
        by_id.setdefault("null" if name is None else str(name), []).append(words(text))
    for r in rows:
        own = words(dict(docs)[r.doc_id])
        for m in r.matches:  # every match is verbatim, and can't be longer
            assert any(own[m.doc_start : m.doc_start + m.n_words] == w[m.item_start : m.item_start + m.n_words] for w in by_id[m.item_id])
        assert r.kept.spans == "x"


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 700)
    check(spark, *tables())


def test_items_that_share_a_beginning(spark):
    """A prompt that all items begin with: its windows are searched once, and
    every item counts; without ``matches`` no place of an item is listed."""
    rng = random.Random(9)
    prompt = prose(rng, 30)
    items = [(i, f"{prompt} {prose(rng, 5)}") for i in range(200)]
    docs = [(i, f"{prose(rng, 8)} {prompt} {prose(rng, 8)}") for i in range(10)]
    test = dc.TestSuffixes([(str(i), t) for i, t in items], 13)
    assert len(test.low) < 18 + 200 * 10 and len(test.of) == 200 * 23
    rows = check(spark, docs, items)
    assert all(len(r["items"]) == 200 for r in rows)
    out = dc.find_contamination(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS), matches=False)
    plain = {r.doc_id: (r.spans, r["items"]) for r in rows}
    assert all((r.spans, r["items"], r.matches) == (*plain[r.doc_id], []) for r in out.collect())


def test_memory_of_a_block():
    """Bytes held for the windows of a benchmark block: 26 times its text at most."""
    import tracemalloc
    rng = np.random.default_rng(1)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 30_000, 2000)) for _ in range(150)]
    size = sum(map(len, text))
    tracemalloc.start()
    dc.TestSuffixes([(str(i), t) for i, t in enumerate(text)], 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * size


def test_empty_tables(spark):
    docs, items = tables()
    check(spark, docs[:5], [])
    check(spark, [], items)


def test_rule(spark):
    rows = spark.createDataFrame([(20, 1), (21, 1), (5, 0), (0, 0)], "n long, h long")
    assert [r[0] for r in rows.select(dc.contaminated(rows.n, rows.h)).collect()] == [True, False, False, False]
