"""Periodic runs against a comparison of every word with the one a period on."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import queries, runs
from tests.llm.helpers import odd_documents, prose

SCHEMA = "doc_id long, text string, runs string, `a.b` int"


def plain_runs(words, shortest=12):
    """{(start, end): smallest period}, every period tried."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(shortest, 2 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_kept(words, found):
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def by_arrays(docs, shortest=12):
    number = np.array([x for d in docs for x in d], np.int64)
    bounds = np.cumsum([0, *map(len, docs)])
    out = [[] for _ in docs]
    for of, *run in zip(*(c.tolist() for c in runs.find_runs(number, bounds, shortest))):
        out[of].append(tuple(run))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.lists(st.integers(0, 2), max_size=60)), max_size=4), st.sampled_from([4, 6, 12]))
def test_small_alphabets(parts, shortest):
    docs = [[x % k for x in d] for k, d in parts]
    assert by_arrays(docs, shortest) == [plain_runs(d, shortest) for d in docs]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_strings_with_many_runs():
    thue = [bin(i).count("1") % 2 for i in range(300)]
    docs = [fibonacci(300), thue, [0] * 200, [0, 1] * 90, [0] * 30 + [1] + [0] * 30 + [1] + [0] * 31, [0, 1, 2] * 4 + [0, 1] * 9, []]
    docs += [d[:] for d in docs]  # equal documents stay apart
    assert by_arrays(docs) == [plain_runs(d) for d in docs]
    assert by_arrays(docs, 2) == [plain_runs(d, 2) for d in docs]


def test_suffix_and_lcp_arrays():
    rng = random.Random(4)
    for k, n in ((1, 50), (2, 200), (30, 300)):
        s = np.array([rng.randrange(k) for _ in range(n)] + [99])
        sa, isa = runs.suffix_array(s)
        plain = sorted(range(n + 1), key=lambda i: s[i:].tolist())
        assert sa.tolist() == plain and isa[sa].tolist() == list(range(n + 1))
        lcp = runs.lcp_array(s, sa)
        for r in range(1, n + 1):
            a, b = s[sa[r - 1] :].tolist(), s[sa[r] :].tolist()
            assert lcp[r] == next(i for i in range(len(a)) if i >= len(b) or a[i] != b[i])


def test_one_period_of_a_very_long_text_is_not_quadratic():
    (found,) = by_arrays([[0] * 300_000])
    assert found == [(0, 300_000, 1)]
    (found,) = by_arrays([list(range(500)) * 400])
    assert found == [(0, 200_000, 500)]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += prose(rng, rng.randint(0, 20)).split() + prose(rng, rng.randint(1, 9)).split() * rng.randint(1, 6)
            if parts and rng.random() < 0.3:
                parts = parts[:-1]
        rows.append((i, rng.choice([" ", "\n", " \t", "\x0b  "]).join(parts)))
    rows += [(3, rows[3][1])] * 2 + [(None, rows[5][1]), (None, None), (200, None), (201, ""), (202, "  \n"), (203, "a " * 12), (204, "a " * 11),
             (205, " é b" * 7), (206, "A a " * 3 + "a A " * 30_000), (207, "a b " * 13)]
    return rows


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.mark.parametrize("seed", [1, 2])
def test_documents(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = runs.collapse_runs(df, keep=("runs", "a.b")).collect()
    want = []
    for i, t in rows:
        words = split(t)
        # the long text has too many words to try all periods
        found = [(6, 60_000, 2)] if i == 206 else plain_runs(words)
        want.append((str(i), len(words), found, plain_kept(words, found)))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert all(r.kept.runs == "x" for r in got) and any(r.runs for r in got)
    assert runs.collapse_runs(df.limit(0)).count() == 0


def test_longest_run(spark):
    df = spark.createDataFrame([(1, "b " * 12 + "c " * 13 + "d " * 13, "", 1), (2, "x", "", 1)], SCHEMA)
    got = {r.doc_id: r.best for r in runs.collapse_runs(df).withColumn("best", runs.longest_run("runs")).collect()}
    assert tuple(got[1]) == (12, 13, 1) and got[2] is None


def check_query(spark, sf, docs):
    """Every row of the query against a trial of every period."""
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()), key=str)
    want, periodic = [], 0
    for r in docs:
        words = split(r.text)
        n, h = len(words), zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(words) if n <= 3000 else []
        periodic += bool(found) and h % 10 == 0
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(plain_kept(words, found).encode()).hexdigest()))
    long = {r.doc_id for r in docs if len(split(r.text)) > 3000}  # too many periods to try
    assert [x for x in got if x[0] not in long or x[0] is None] == sorted((x for x in want if x[0] not in long or x[0] is None), key=str) and len(got) == len(want)
    return periodic


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    assert check_query(spark, sf, spark.read.parquet(f"{sf}/documents.parquet").collect()) > 5


def test_query_on_odd_documents(spark):
    path, _ = odd_documents(spark)
    assert check_query(spark, path, spark.read.parquet(f"{path}/documents.parquet").collect()) > 0
