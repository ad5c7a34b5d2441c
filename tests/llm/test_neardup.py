"""Near-duplicate documents against all pairs."""

import random

import numpy as np
import pytest

from quarry.llm import neardup
from quarry.llm.components import connected_components, least_of_group
from tests.llm.helpers import edited, prose

SCHEMA = "doc_id long, text string, node string, component_id long"


def sets_of(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_force(rows, size, percent):
    """(doc_id, n_shingles, component_id) of each row by comparing all rows."""
    sets = [sets_of(r[1], size) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return sorted((str(r[0]), len(sets[k]), str(least[group[k]])) for k, r in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    base = prose(rng, 150)
    rows += [(100 + i, edited(rng, base, rng.randint(1, 5))) for i in range(40)] + [(99, base)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(10)] + [(i, rows[i][1]) for i in (3, 3)]
    rows += [(None, base), (None, "lonely row"), (300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "long " * 20_000)]
    return [(*r, "x", 7) for r in rows]


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 85), (2, 5, 80)])
def test_against_all_pairs(spark, seed, size, percent):
    rows = corpus(seed)
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size, percent).collect()
    want = brute_force(rows, size, percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert {r.doc_id for r in out if not r.n_shingles} == {300, 301, 302}


@pytest.mark.parametrize("size", [{"BLOCK_BYTES": 6000}, {"BLOCK_MEMBERS": 6}])
def test_small_blocks(spark, monkeypatch, size):
    """Groups that span many cells give the same result."""
    rows = corpus(3)
    for name, n in size.items():
        monkeypatch.setattr(neardup, name, n)
    monkeypatch.setattr(neardup, "_stars", lambda met, percent: met.select("node", met.node.alias("to")).limit(0))
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute_force(rows, 3, 85)


def test_signatures_part_what_a_key_joins(spark, monkeypatch):
    """Templated texts share keys by chance and chain up; candidates by Hamming
    distance do not, and the links are those of all pairs."""
    rng = random.Random(12)
    template = prose(rng, 120).split()
    rows = []
    for i in range(150):
        words = [w if rng.random() < 0.8 else prose(rng, 1) for w in template]
        rows += [(2 * i, " ".join(words), "", 0), (2 * i + 1, edited(rng, " ".join(words), rng.randint(1, 2)), "", 0)]
    sizes = []
    plain = neardup._in_cells
    monkeypatch.setattr(neardup, "_in_cells", lambda members, *a: (sizes.append(members.groupBy("group").count().agg({"count": "max"}).first()[0]), plain(members, *a))[1])
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute_force(rows, 3, 85)
    assert len(sizes) == 2 and (sizes[1] or 0) < (sizes[0] or 0)


def test_signatures_of_near_texts_are_near():
    """The Hamming distance of signatures estimates the similarity: pairs at
    0.85 are within FAR."""
    rng = np.random.default_rng(13)
    for _ in range(60):
        base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (neardup.signature(np.sort(np.concatenate([base[:340], rng.integers(0, 1 << 63, 30).astype(np.uint64)]))) for _ in range(2))
        assert (a != b).sum() <= neardup.FAR


def test_no_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_cover_every_error_pattern():
    """Signatures that differ in up to CHUNKS * (ERRORS + 1) - 1 symbols share a key."""
    rng = np.random.default_rng(5)
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.CHUNKS * neardup.WIDTH).astype(np.uint64)
        b = a.copy()
        b[rng.choice(len(a), most, replace=False)] ^= np.uint64(1)
        assert np.isin(neardup.index_keys(a), neardup.index_keys(b)).any()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = least_of_group(500, np.array([a for a, b in edges if a is not None]), np.array([b for a, b in edges if a is not None]))
    used = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: int(label[x]) for x in used}
