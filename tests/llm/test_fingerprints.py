"""Fingerprints against a plain computation, and their likeness against the
generalised Jaccard similarity of the word counts."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import fingerprints as fp
from quarry.llm import queries
from quarry.llm.hashing import batch_words
from tests.llm.helpers import odd_documents, prose

SCHEMA = "doc_id long, text string, hash string, `a.b` int"


def jaccard(a, b):
    x, y = Counter(a.encode().split()), Counter(b.encode().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def signatures(texts):
    return fp.signatures(*batch_words(pa.array(texts)))


def test_samples_are_those_of_the_stated_formula():
    """Gamma quantiles by bisection, one (term, weight) at a time."""
    def quantile(u):
        lo, hi = 0.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < u else (lo, mid)
        return lo

    rng = random.Random(5)
    terms = np.array([rng.getrandbits(64) for _ in range(20)], np.uint64)
    weights = np.array([rng.choice([1, 1, 2, 3, 50]) for _ in range(20)])
    got = fp.sample_costs(terms, weights)
    odd = [int(x) for x in fp._tables()[2]]
    for i, (term, w) in enumerate(zip(terms.tolist(), weights.tolist())):
        for k in (0, 1, 77, 127):
            h = term * odd[k] % 2**64
            r, c, b = quantile(((h >> 48) + 0.5) / 65536), quantile(((h >> 32 & 0xFFFF) + 0.5) / 65536), (h >> 8 & 0xFFFFFF) / 2**24
            t = math.floor(math.log(w) / r + b)
            assert abs(got[i, k] - math.log(c / (math.exp(r * (t - b)) * math.exp(r)))) < 1e-4


def test_quantiles_are_gamma():
    q = fp.gamma_quantiles()
    assert (np.diff(q) > 0).all() and abs(q.mean() - 2) < 1e-3 and abs(q.var() - 2) < 1e-2


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(6)
    real, seen = [], []
    for _ in range(300):
        words = [prose(rng, 1) for _ in range(rng.randint(1, 8))]
        a = " ".join(rng.choices(words, k=rng.randint(1, 60)))
        b = " ".join(rng.choices(words[: rng.randint(1, 8)] + [prose(rng, 1)], k=rng.randint(1, 60)))
        if rng.random() < 0.4:  # much alike
            b = " ".join(a.split()[rng.randint(0, 5) :] + b.split()[: rng.randint(0, 8)])
        x, y = signatures([a, b])
        real.append(jaccard(a, b))
        seen.append((x == y).mean())
    real, seen = np.array(real), np.array(seen)
    assert abs((seen - real).mean()) < 0.01  # no bias
    assert np.abs(seen - real).max() < 0.2 and np.std(seen - real) < 0.05  # sqrt(1/4/128) = 0.044
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = (real >= lo) & (real <= lo + 0.25)
        assert abs((seen - real)[part].mean()) < 0.02


def test_equal_texts_in_any_batch():
    rng = random.Random(7)
    texts = [prose(rng, n) for n in (1, 5, 300, 40, 0, 20_000)]
    alone = [signatures([t])[0] for t in texts]
    for _ in range(5):
        order = rng.choices(range(len(texts)), k=12)
        for i, row in zip(order, signatures([texts[i] for i in order])):
            assert (row == alone[i]).all()
    assert (alone[4] == 0).all() and all((a > 0).all() for i, a in enumerate(alone) if i != 4)


def rows():
    rng = random.Random(8)
    out = [(i * 7 % 501, prose(rng, rng.randint(0, 40))) for i in range(200)]
    out += [(3, out[3][1])] + [(None, f"n{i}") for i in range(50)] + [(None, None), (-(1 << 63), "least"), (9999, "long " * 50_000), ((1 << 53) + 1, "b"), (1 << 53, "a")]
    return out


def test_next_rows(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA).repartition(6)
    got = [(r.doc_id, r.text, r.next_text) for r in fp.with_next(df).collect()]
    hashes = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in data], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i is not None, i or 0, hashes[t or ""], t or "") for i, t in data))
    want = [(i if known else None, t, order[(k + 1) % len(order)][3]) for k, (known, i, _, t) in enumerate(order)]
    assert Counter(got) == Counter(want)


def test_next_of_few_rows(spark):
    one = spark.createDataFrame([(5, "only", "", 1)], SCHEMA)
    assert [tuple(r) for r in fp.with_next(one).collect()] == [(5, "only", "only")]
    same = spark.createDataFrame([(5, "a", "", 1)] * 3, SCHEMA)
    assert [tuple(r) for r in fp.with_next(same).collect()] == [(5, "a", "a")] * 3
    assert fp.with_next(one.limit(0)).count() == 0
    assert fp.fingerprint(one.limit(0), {"f": F.col("text")}, {"doc_id": F.col("doc_id")}).count() == 0


def test_likeness(spark):
    rng = random.Random(9)
    a = prose(rng, 200)
    pairs = [(a, a), (a, a + " " + a), (a, prose(rng, 200)), ("", ""), (None, ""), ("", "x"), ("x  y", "y\nx")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    out = fp.fingerprint(df, {"x": F.col("a"), "y": F.col("b")}, {"i": F.col("i")}).withColumn("near", fp.likeness(F.col("x"), F.col("y")))
    near = [r.near for r in out.orderBy("i").collect()]
    assert near[0] == near[3] == near[4] == near[6] == 1 and near[5] == 0 and 0.3 < near[1] < 0.7
    assert abs(near[2] - jaccard(*pairs[2])) < 0.15


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op12_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    by_text, off = {}, []
    for k, (i, text) in enumerate(docs):
        after, x, n = docs[(k + 1) % len(docs)][1], got[i], len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        assert x.n_chars == n and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, x.fingerprint) == x.fingerprint and by_text.setdefault(edited, x.edited_fingerprint) == x.edited_fingerprint
        off += [abs(x.near_edited - jaccard(text, edited)), abs(x.near_next - jaccard(text, after))]
    assert len(set(by_text.values())) > 0.9 * len(by_text) and max(off) < 0.2 and sum(off) / len(off) < 0.04


def test_query_on_odd_documents(spark):
    path, rows = odd_documents(spark)
    got = queries.op12_fingerprints(spark, path).collect()
    assert len(got) == len(rows) and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    hashes = {r.text: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i is not None, i or 0, hashes[t or ""], t or "") for i, t, *_ in rows))
    want = Counter()
    for k, (known, i, _, t) in enumerate(order):
        after, n = order[(k + 1) % len(order)][3], len(t)
        want[i if known else None, n, hashlib.sha256((t[: n - n // 4] + after[: n // 4]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
