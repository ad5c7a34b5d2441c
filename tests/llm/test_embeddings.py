"""Near-duplicate vectors against all pairs in double precision."""

import numpy as np
import pytest

from quarry.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute_force(rows):
    ok = [k for k, r in enumerate(rows) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = {k: set() for k in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links[i].add(j)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            todo = [y for x in todo for y in links[x] if y not in seen and not seen.add(y)]
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((str(rows[k][0]), len(links[k]), str(least), rows[k][0] == least))
    return sorted(out)


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(80)]
    centre = rng.normal(size=16)
    rows += [(100 + i, (centre + rng.normal(0, 0.25, 16)).tolist()) for i in range(60)]
    rows += [(200 + i, rows[85][1]) for i in range(5)] + [(3, rows[3][1])] * 2
    nan, big = [float("nan")] + [1.0] * 15, [1e30] * 16
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, nan), (304, [None] * 16), (305, [1.0, 2.0]), (306, [2.0, 4.0]),
             (307, big), (308, [1.0] * 16), (None, rows[85][1]), (None, None), (309, [-0.0] * 15 + [1.0]), (310, [0.0] * 15 + [5.0])]
    return [(*r, "x") for r in rows]


@pytest.mark.parametrize("block", [8192, 16])
def test_against_all_pairs(spark, block):
    rows = vectors(block)
    out = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), 0.9, block=block)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out.collect()) == brute_force(rows)


def test_doubles_and_further_columns(spark):
    rows = [(i, [1.0, i * 0.1 + 1e-9], "x", "y") for i in range(9)] + [(None, [None, 1.0], "x", "y")]
    out = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, `a.b` array<double>, block string, vec string"), 0.99, vec_col="a.b").collect()
    links = [sum(i != j and (1 + i * j * 0.01) / ((1 + i * i * 0.01) * (1 + j * j * 0.01)) ** 0.5 >= 0.99 for j in range(9)) for i in range(9)]
    assert {r.vec_id: r.n_links for r in out} == {**dict(enumerate(links)), None: 0}


def clusters(rng, n):
    return [(i, (np.eye(20)[i % 8] * 6 + rng.normal(0, 0.4, 20)).tolist(), "x") for i in range(n)]


def test_cells_without_links_are_skipped(spark):
    """Clusters at right angles: few cells are left, and no link is lost."""
    rng = np.random.default_rng(3)
    rows = clusters(rng, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    out = embeddings.near_duplicate_vectors(df, 0.9, block=12)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out.collect()) == brute_force(rows)
    alike = spark.createDataFrame([(bytes([i % 256, i // 256]), np.array(r[1], np.float32).tobytes(), 1, 20) for i, r in enumerate(rows)],
                                  "node binary, vec binary, copies long, dim int")
    near = embeddings._around(alike, embeddings._pivots(alike, 16)).toPandas()
    layout = embeddings._layout(0.9, 12)(near.groupby("pivot").agg(dim=("dim", "first"), n=("node", "size"), radius=("angle", "max"), centre=("centre", "first")).reset_index())
    assert len(layout) > 8 and layout.others.map(len).max() < 0.6 * layout.blocks.sum()


def test_a_bound_of_angles_excludes_no_link():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    centres = x[:25]
    cosine = x @ centres.T
    near = cosine.argmax(axis=1)
    radius = np.array([np.arccos(np.minimum(1, cosine[near == p, p])).max() for p in range(25)])
    for threshold in (0.8, 0.9, 0.99):
        meets = embeddings.may_link(centres, radius, threshold)
        assert all(meets[near[i], near[j]] for i, j in zip(*np.nonzero(x @ x.T >= threshold))) and not meets.all()


def test_bounds_hold():
    """No pair at the threshold escapes its bound, whatever the tiles."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 24))
    x[350:] = x[:350] + rng.normal(0, 0.45, (350, 24))
    a = embeddings.Codes([r.tobytes() for r in x], 24)
    exact = a.unit @ a.unit.T
    for threshold in (0.3, 0.85, 0.9, 0.95):
        found = {(int(i), int(j)) for p, q in embeddings.linked_pairs(a, a, threshold, True) for i, j in zip(p, q)}
        assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(exact >= threshold, 1)))}


def test_no_rows(spark):
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
