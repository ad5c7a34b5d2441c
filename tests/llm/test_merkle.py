"""Merkle manifest against a tree built plainly in memory."""

import hashlib
import random

from pyspark.sql import functions as F

from quarry.llm import merkle, queries
from tests.llm.helpers import odd_documents, prose

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, `a.b` int, key string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def plain_tree(leaves):
    """Top and the siblings of each leaf, every level as a list of its own."""
    proofs, under = [""] * len(leaves), [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        runs = [range(i, min(i + 3, len(leaves))) for i in range(0, len(leaves), 3)]
        for run in runs:
            for i in run:
                for leaf in under[i]:
                    proofs[leaf] += "".join(leaves[j] for j in run if j != i)
        under = [[x for i in run for x in under[i]] for run in runs]
        leaves = [sha("".join(leaves[i] for i in run)) for run in runs]
    return leaves[0], proofs


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, within = [], []
    for s in order:
        leaves = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r)) for r in groups[s]))
        top, proofs = plain_tree([x[2] for x in leaves])
        tops.append(top)
        within.append([(k, leaf, p) for (_, k, leaf), p in zip(leaves, proofs)])
    root, above = plain_tree(tops)
    return sorted((leaf, top, root, p + a) for leaves, top, a in zip(within, tops, above) for _, leaf, p in leaves)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    rows, ids = [], iter(rng.sample(range(10**6), sum(sizes.values())))
    for source, n in sizes.items():
        rows += [(next(ids), source, rng.choice(["en", None, ""]), rng.choice([None, 5]), rng.choice([None, "", prose(rng, 4) + "\n", "é\n\n"])) for _ in range(n)]
    return rows


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA).repartition(parts)
    return merkle.manifest(df, FIELDS, carry={"text": F.col("text")})


def test_against_plain_trees(spark, monkeypatch):
    sizes = {None: 4, "": 1, "a": 3, "b": 2, "hot": 800, "é": 28, "z": 27, "zz": 9, "c": 10}
    rows = corpus(sizes)
    out = run(spark, rows).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"), F.col("proof")))
    got = out.collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in got) == plain(rows)
    assert all(r.folded == r.root for r in got)
    assert {r.key for r in got} == {r[0] for r in rows} and all(isinstance(r.carried.text, (str, type(None))) for r in got)


def test_forward_and_backward_sweeps_of_every_small_size():
    for n in (1, 2, 3, 4, 7, 9, 10, 26, 27, 28, 80):
        leaves = [sha(str(i)) for i in range(n)]
        top, proofs = plain_tree(leaves)
        got, nodes = merkle.forward(leaves, merkle._height(n))
        ends = merkle.backward(nodes, n, "", "")
        assert got == top and [p for _, p in ends] == proofs
        # a block of a larger tree goes up to the full height
        got, nodes = merkle.forward(leaves, 6)
        for _ in range(6 - merkle._height(n)):
            top = sha(top)
        assert got == top and len(merkle.backward(nodes, n, "", "")[0][0]) == 12


def test_several_rounds(spark, monkeypatch):
    # two full blocks and a part, so a second round of blocks
    rows = [(i, "s", "en", 1, str(i)) for i in range(2 * merkle.BLOCK + 5)] + [(10**7, "t", None, None, None)]
    got = run(spark, rows, 7).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in got) == plain(rows)


def test_ties_repeated_rows_nulls_and_no_rows(spark):
    rows = [(1, "a", "en", 3, "x"), (1, "a", "en", 3, "x"), (1, "a", "en", 3, "y"), (None, "a", None, None, None), (None, "a", "", 0, ""),
            (2, None, "en", 1, "w " * 100_000), (None, None, None, None, None)]
    got = run(spark, rows).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in got) == plain(rows)
    assert run(spark, rows[:0], 1).count() == 0
    lone = run(spark, rows[:1]).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"), F.col("proof"))).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded == plain_leaf(rows[0]) and lone.proof == ""


def test_query_finds_the_tampered_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_merkle_manifest(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    import zlib

    changed = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text and "\n" in r.text}
    assert len(got) == len(docs) and {r.doc_id for r in got if not r.verified} == changed and changed
    want = {x[0]: x for x in plain([tuple(r[c] for c in FIELDS) for r in docs])}
    assert all((r.leaf, r.subroot, r.root) == want[r.leaf][:3] and r.proof_sha256 == sha(want[r.leaf][3]) for r in got)


def test_query_on_odd_documents(spark):
    path, rows = odd_documents(spark)
    got = queries.op13_merkle_manifest(spark, path).collect()
    want = plain([(i, source, lang, n, text) for i, text, lang, source, n in rows])
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == sorted((a, b, c, sha(p)) for a, b, c, p in want)
    assert {r.verified for r in got} == {True, False}
