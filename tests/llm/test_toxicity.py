"""Ordinal regression: gradient-fitted order, held-out accuracy on the test tables, edge cases."""

import random

import numpy as np
import pytest

from fundweave.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.with_severity(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).select("toxic", "__severity").collect()
    toxic = np.array([r["__severity"] for r in rows if r.toxic])
    clean = np.array([r["__severity"] for r in rows if not r.toxic])
    rank = (toxic[:, None] > clean[None]).mean() + 0.5 * (toxic[:, None] == clean[None]).mean()
    assert rank > 0.95
    assert (clean >= model.reject_at).mean() < 0.02 and (toxic >= model.reject_at).mean() > 0.6


def test_thresholds_are_ordered_and_shared_weights_grade(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 3
        ws = [r.choice("alpha beta gamma delta".split()) for _ in range(40)] + ["vile", "nasty", "rotten", "foul"][: 2 * bad]
        rows.append((" ".join(ws), bad))
    index = [toxicity.features(t) for t, _ in rows]
    grades = np.array([g for _, g in rows])
    model = toxicity.fit(index, toxicity.scales(index, grades > 0), grades)
    assert (np.diff(model.thresholds) > 0).all()
    score = toxicity.Scorer(model)
    mean = [np.mean([score(t) for t, g in rows if g == k]) for k in range(3)]
    assert mean[0] < 0.7 < mean[1] < mean[2]


def _loss(x, rows, scale, used, grades, levels, l2):
    """Plain form of the penalised likelihood: a probability for each row by its own sum."""
    w, cut = dict(zip(used.tolist(), x[: len(used)].tolist(), strict=True)), x[len(used) :]
    share, out = (grades > 0).mean(), 0.0
    for index, g in zip(rows, grades.tolist(), strict=True):
        f = sum(w[b] * abs(scale[b]) for b in index.tolist() if b in w)
        above = [1.0, *(1 / (1 + np.exp(c - f)) for c in cut), 0.0]
        out -= np.log(above[g] - above[g + 1]) * (0.5 / share if g else 0.5 / (1 - share)) / len(rows)
    return out + l2 / 2 * (x[: len(used)] ** 2).sum()


def test_the_fit_is_the_minimum_of_the_plain_loss():
    r = random.Random(4)
    words = "vile nasty alpha beta gamma".split()
    grades = np.array([i % 3 for i in range(90)])
    texts = [" ".join(w for k, w in enumerate(words) if r.random() < (0.2 + 0.3 * g if k < 2 else 0.5)) for g in grades.tolist()]
    rows = [toxicity.features(t) for t in texts]
    scale = toxicity.scales(rows, grades > 0, least_odds=0.1)
    model = toxicity.fit(rows, scale, grades, l2=0.05, steps=4000, rate=0.01)
    used = np.unique(np.concatenate([i[scale[i] != 0] for i in rows]))
    x = np.concatenate([model.weights[used] / np.abs(scale[used]), model.thresholds])
    best = _loss(x, rows, scale, used, grades, 2, 0.05)
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-3
        slope = (_loss(x + step, rows, scale, used, grades, 2, 0.05) - _loss(x - step, rows, scale, used, grades, 2, 0.05)) / 2e-3
        assert abs(slope) < 2e-3
        assert _loss(x + 50 * step, rows, scale, used, grades, 2, 0.05) > best < _loss(x - 50 * step, rows, scale, used, grades, 2, 0.05)


def test_grades_are_votes_of_raters_that_have_not_seen_the_row():
    r = random.Random(6)
    rows, toxic = [], []
    for i in range(300):
        bad = i % 4 == 0
        ws = [r.choice("alpha beta gamma delta eps".split()) for _ in range(12)] + (["vile", "foul", "rotten"][: 1 + i % 3] if bad else [])
        rows.append(toxicity.features(" ".join(ws)))
        toxic.append(bad)
    # A word of its own is known to no rater but that of the row's own part.
    rows[0], toxic = toxicity.features("uniqueword"), np.array(toxic)
    grades = toxicity.severity_grades(rows, toxic, 2)
    assert (grades[~toxic] == 0).all() and set(grades[toxic].tolist()) <= {1, 2} and grades[0] == 1
    assert (grades[toxic] == 2).mean() > 0.5


def test_the_sample_is_bounded_in_features(spark):
    docs = spark.createDataFrame([(i, f"word{i} {('nice', 'vile')[i % 2]} " + " ".join(f"w{i}x{k}" for k in range(50))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    few, every = toxicity.train(docs, labels, sample_features=300), toxicity.train(docs, labels)
    assert few.weights.nonzero()[0].tolist() != every.weights.nonzero()[0].tolist()
    again = toxicity.train(docs.repartition(7), labels)
    assert (again.weights == every.weights).all() and again.reject_at == every.reject_at


def test_columns_that_have_the_names_of_new_ones(spark):
    docs = spark.createDataFrame([(1, "x", 5, 6), (2, None, 5, 6)], "doc_id long, text string, severity int, __Severity int")
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), np.array([9.0, 10.0]))
    assert sorted(tuple(r) for r in toxicity.reject_toxic(docs, model).collect()) == [(1, "x", 5, 6), (2, None, 5, 6)]
    assert toxicity.with_severity(docs, model).columns == ["doc_id", "text", "severity", "__severity"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (None, "", 2.0), (3, "idiot " * 50_000, 2.0), (3, "x", 2.0), (3, "x", 2.0)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (9, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.with_severity(docs, model)
    assert got.count() == 5 and got.columns == ["doc_id", "text", "severity", "__severity"]
    assert toxicity.with_severity(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r["__severity"] for r in toxicity.with_severity(docs, none).collect()} == {0.0}
    assert toxicity.reject_toxic(docs, none).count() == 5


def test_scorer_equals_features():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), np.array([0.5, 1.0]))
    score = toxicity.Scorer(model)
    for text in ("", None, "One two, THREE three", "été über-lang longest! word" * 3):
        f = model.weights[toxicity.features(text)].sum(dtype=np.float64)
        assert score(text) == pytest.approx(float(toxicity.severity(np.array(f), model.thresholds)))
