"""The lexicon automaton against edit distances, and held-out accuracy."""

import random

import pyarrow as pa
import pytest

from quarry.llm import toxicity as tox
from tests.llm.helpers import prose

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["idiot", "moron", "worthless", "trash", "scum", "moronic"]
    lexicon = tox.Lexicon({t: 1.0 for t in terms})
    letters = "idotmrnwhlesacu1*"
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        w = "".join(w)
        if len(w) >= 3:
            best = min(distance(w, t) for t in terms)
            found = lexicon.match(w)
            assert (found is not None) == (best <= 1), w
            assert best > 1 or (found[0] == tox.EXACT) == (best == 0), w


def test_kinds():
    lexicon = tox.Lexicon({"idiot": 1.0, "worthless": 0.9, "vequ*": 0.8})
    kind = lambda w: (lexicon.match(w) or (None,))[0]
    assert [kind(w) for w in ("idiot", "id1ot", "idiiot", "worthles", "idot")] == [tox.EXACT, tox.ODD, tox.ODD, tox.LONG_EDIT, tox.SHORT_EDIT]
    assert kind("vequeur") == tox.EXACT and kind("vequ") == tox.EXACT and kind("vexu") is None and kind("ab") is None


def test_context():
    seen = tox._Seen(tox.Lexicon({"idiot": 1.0}))
    plain, quoted = (tox.features(t.split(), seen) for t in ("you are an Idiot, truly", 'he said "what an idiot" to them'))
    assert plain[1] == 1.0 and plain[5] == 0 and quoted[1] == 0 and quoted[5] == 1.0
    weights = tox.PRIOR
    assert sum(w * x for w, x in zip(weights, plain)) > 0 > sum(w * x for w, x in zip(weights, quoted))
    texts = ["", " \n", "you are an Idiot, truly", "  what a day ", 'he said "what an idiot" to them']
    blank = [1.0] + [0.0] * 9
    assert tox._batch_features(pa.array(["dropped", *texts]).slice(1), seen) == [blank, blank, plain, blank, quoted]


def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(rng, rng.randint(20, 60)).split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Zanker", "zanker!", "quolbert", "Quolberts"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    docs += [(700, None, "x"), (701, "", "x"), (None, "zanker", "x"), (3, docs[3][1], "x"), (702, "you z4nker", "x"), (703, "word " * 50_000, "x")]
    labels += [(None, 1, 1), (5000, 0, 1), (7, 1, None), (8, 1, 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_model(spark):
    docs, labels = labelled(spark)
    model = tox.fit(docs, labels)
    assert any(t.startswith("zanker") for t in model.terms) and any(t.startswith("quolb") for t in model.terms)
    out = {r.doc_id: r for r in tox.score(docs, model, keep=("score",)).collect()}
    assert all((out[i].score >= 0.5) == (i % 6 == 0) for i in range(600)) and out[5].kept.score == "x"
    assert out[700].score == out[701].score < 0.5 <= out[None].score and out[702].score >= 0.5
    assert tox.score(docs, model).count() == docs.count()


def test_inflected_terms_match_with_an_edit(spark):
    chosen = tox.choose_terms([("idiot", 0, 40), ("idiots", 0, 30), ("idio*", 0, 70), ("idiot*", 0, 30)], 500, 100)
    assert set(chosen) == {"idio*", "idiot", "idiots"} and len(set(chosen.values())) == 1
    lexicon = tox.Lexicon(chosen)
    kind = lambda w: (lexicon.match(w) or (None,))[0]
    assert [kind(w) for w in ("idiot", "idiotic", "id1ot", "idiiot", "1diots", "idxot")] == [tox.EXACT, tox.EXACT, tox.ODD, tox.ODD, tox.ODD, tox.SHORT_EDIT]
    docs, labels = labelled(spark)
    model = tox.fit(docs, labels)
    assert any(t.startswith("quolb") and t.endswith("*") for t in model.terms)
    more = spark.createDataFrame([(1, "you qu0lbert", "x"), (2, "two quo1berts", "x"), (3, "you zank", "x")], "doc_id long, text string, score string")
    score = {r.doc_id: r.score for r in tox.score(more, model).collect()}
    assert score[1] >= 0.5 and score[2] >= 0.5 > score[3]


def test_terms_of_any_number_and_length(spark, monkeypatch):
    """3,000 terms, one of 40 characters and one of two; both ways of counting."""
    rng = random.Random(8)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(3000)] + ["w" + "xyz" * 13, "qx"]
    docs = [(i, " ".join(names[k] for k in range(len(names)) if (k + i) % 40 < 20 or k >= 3000), "x") for i in range(80)]
    docs += [(1000 + i, prose(rng, 30), "x") for i in range(700)]
    labels = spark.createDataFrame([(d, 1, int(d < 1000)) for d, _, _ in docs], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = tox.fit(docs, labels)
    whole = {t for t in model.terms if not t.endswith("*")}
    lexicon = tox.Lexicon(model.terms)
    assert all(lexicon.match(t) for t in names) and len(model.terms) > 2900 and "qx" in whole and names[3000] in model.terms
    assert lexicon.match("qy") is None and lexicon.match("q") is None
    monkeypatch.setattr(tox, "CANDIDATES_SENT", 10)
    assert tox.fit(docs, labels) == model
    assert len(tox.fit(docs, labels, most_terms=5).terms) >= 5


def test_a_document_that_occurs_often_counts_as_rows_of_one_text(spark):
    docs, labels = labelled(spark)
    more = docs.union(docs.where("doc_id = 6")).union(spark.createDataFrame([(12, "another text", "x")], docs.schema))
    assert tox.fit(more, labels, fit_rows=500).weights and tox.fit(more, labels).terms.keys() == tox.fit(docs, labels).terms.keys()


def test_logistic_weights_of_repeated_rows():
    """Times of rows are the rows themselves, often."""
    import numpy as np
    rng = np.random.default_rng(1)
    x, y, times = rng.normal(size=(40, 10)), rng.integers(0, 2, 40).astype(float), rng.integers(1, 5, 40)
    each = np.repeat(np.arange(40), times)
    a, b = tox.fit_logistic(x, y, times.astype(float)), tox.fit_logistic(x[each], y[each], np.ones(len(each)))
    assert np.allclose(a, b)
    p = 1 / (1 + np.exp(-x @ a))  # no step from there is better
    assert np.abs(x.T @ (times * (p - y)) + a - tox.PRIOR).max() < 1e-6


@pytest.mark.parametrize("keep", [0, 1])
def test_without_one_label(spark, keep):
    docs, labels = labelled(spark)
    model = tox.fit(docs, labels.where(f"toxic = {keep}"))
    assert model.terms == {} and tox.score(docs.limit(0), model).count() == 0
    assert all(r.score < 0.5 for r in tox.score(docs, model).collect())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = tox.score(docs, tox.fit(docs, labels)).join(labels, "doc_id").where(tox.held_out(labels.doc_id)).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in out)
    assert right >= 0.93 * len(out)
    assert not [r for r in out if r.score >= 0.5 and not r.toxic]


def test_automaton_is_bounded_without_effect(monkeypatch):
    words = [f"{c}orm{i}{c}en" for i in range(40) for c in "abcxz"] + ["zankers", "z4nker", "zanker", "vorpal"]
    terms = {"zanker": 1.0, "vorp*": 0.5, "normaen": 0.7}
    plain = [tox.Lexicon(terms).match(w) for w in words]
    monkeypatch.setattr(tox, "STATES_KEPT", 10, raising=False)
    small, most = tox.Lexicon(terms), 0
    assert [small.match(w) for w in words] == plain and any(plain)
    for w in words:
        small.match(w)
        most = max(most, len(small.sets))
    assert most <= 10 + max(map(len, words)) + 1


def test_kept_text_goes_to_the_task_once(spark):
    docs = spark.createDataFrame([(1, "you zanker", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, lang string")
    model = tox.Model({"zanker": 1.0}, tuple(tox.PRIOR))
    out = tox.score(docs, model, keep=("lang", "text", "doc_id"))
    assert "coalesce(" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.doc_id: r for r in out.collect()}
    plain = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    assert {k: r.score for k, r in rows.items()} == plain and rows[1].kept.text == "you zanker" and rows[2].kept.text is None and rows[3].kept.text == ""
