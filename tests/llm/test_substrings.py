"""Repeated windows against a dictionary of all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import hashing, substrings
from tests.llm.helpers import prose

SCHEMA = "doc_id long, text string, factors string"


def brute_force(rows, window):
    """Rows in order; of rows with one id the texts must be equal."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append((str(doc_id), len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (20, 21, 35, 60, 19)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, max(0, len(p) - 20))
            parts += [" ".join(p[a:]), prose(rng, rng.randint(0, 25))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(10)] + [(9, rows[3][1])] * 2
    rows += [(600, "a " * 100), (601, "a " * 19), (602, None), (603, ""), (604, "a b " * 5000), (None, rows[50][1]), (605, "é " * 30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    out = substrings.remove_repeats(df, keep=("factors",)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in out) == brute_force(rows, substrings.WINDOW)
    assert all(sum(f.stop - f.start for f in r.factors) == r.n_removed and r.kept.factors == "x" for r in out)


def test_rows_of_one_id_and_no_rows(spark):
    rng = random.Random(3)
    text = prose(rng, 40)
    out = substrings.remove_repeats(spark.createDataFrame([(1, text + " x", ""), (1, "y " + text, ""), (None, None, "")], SCHEMA)).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 40]
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_whose_hashes_share_33_bits(spark):
    """Spark's xxhash64 of a string is XXH64 with seed 42."""
    rng = random.Random(11)
    head, seen, n = prose(rng, 21), {}, 0
    while True:
        text = f"w{n} {head}" if n % 2 else f"{prose(rng, 21)} w{n}"
        h = xxhash.xxh64_intdigest(text.encode(), 42) % (1 << 33)
        if n % 2 and h in seen and not set(seen[h].split()) & set(text.split()):
            break
        if not n % 2:
            seen[h] = text
        n += 1
    other = seen[h]
    rows = [(None, text, ""), (None, other, ""), (1, f"{text} x", "")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text: r.n_removed for r in out} == {text: 0, other: 0, f"{text} x": 22}


def test_gram_hashes_depend_on_every_word():
    words = np.arange(60, dtype=np.uint64) * np.uint64(7919)
    for size in (1, 2, 3, 5, 13, 20):
        h = hashing.gram_hashes(words, size)
        assert len(h) == 60 - size + 1 == len(set(h.tolist()))
        for k in range(size):
            other = words.copy()
            other[30 + k] += np.uint64(1)
            assert hashing.gram_hashes(other, size)[30] != h[30]


def test_batch_hashes_part_words_as_bytes_split():
    texts = ["a b", "", " x\t\ny ", "\x0b\x0c", "é A\u00a0B", "A a", "b"]
    column = pa.array(["zero", *texts]).slice(1)
    for lower in (False, True):
        hashes, bounds = hashing.batch_hashes(column, lower)
        split = [(t.encode().lower() if lower else t.encode()).split() for t in texts]
        assert np.diff(bounds).tolist() == [len(w) for w in split]
        flat = [w for ws in split for w in ws]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
