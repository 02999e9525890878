import os
import random

import numpy as np
import pytest

from weirflow.llm import _common
from weirflow.llm import toxicity as t

DIR = "/root/testdata/sf0.01"


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(3000)]
    true = np.array([2.0, 1.5, 1.0, 0.0, 0.0, -1.0])
    s = np.array([true[r].sum() for r in rows]) + rng.logistic(size=3000) * 0.3
    grade = np.searchsorted([1.0, 2.5, 4.0], s)
    w, cut = t.fit_ordinal(rows, grade, 6)
    assert (np.diff(cut) > 0).all() and w[0] > w[1] > w[2] > abs(w[3]) and w[5] < 0
    model = t.Ordinal({}, cut.tolist())
    sev = [sum(model.severity(x)) for x in (-5, 0, 2, 5, 50)]
    assert sev == sorted(sev) and 0 <= sev[0] and sev[-1] <= len(cut)


def test_learns_words_and_leaves_clean_documents(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        if toxic := i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["nasty!", "Vile", "\"rotten\""])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, x, "p") for i, x, _ in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 300] + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = t.learn_toxicity(docs, labels)
    got = {r.doc_id: r.toxic for r in t.score_toxicity(docs, model).collect()}
    assert all(got[i] == bool(y) for i, _, y in rows if i >= 300)
    again = t.learn_toxicity(docs.repartition(5), labels)
    assert again.weights == pytest.approx(model.weights)


def test_no_labels_nulls_and_empty_tables(spark, awkward, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = t.learn_toxicity(awkward, labels)
    got = t.score_toxicity(awkward, model).collect()
    assert len(got) == awkward.count() and not any(r.toxic for r in got) and {r.severity for r in got} == {0.0}
    assert t.score_toxicity(empty, model).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = t.learn_toxicity(docs, labels.where("doc_id % 2 = 0"))
    held = t.score_toxicity(docs, model).join(labels.where("doc_id % 2 = 1 and quality = 1").withColumnRenamed("toxic", "y"), "doc_id").groupBy("y", "toxic").count().collect()
    n = {(r.y, r.toxic): r["count"] for r in held}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.95
    assert n.get((0, True), 0) / (n[0, False] + n.get((0, True), 0)) < 0.01


def test_masked_words_are_scored(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        if toxic := i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["sh#t", "f%ck!", "b#2"])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 300], "doc_id long, quality int, toxic int")
    model = t.learn_toxicity(docs, labels)
    got = {r.doc_id: r.toxic for r in t.score_toxicity(docs, model).collect()}
    assert all(got[i] == bool(y) for i, _, y in rows)
    assert t.levels({"b": 2, "b#2": 1}, 900) == {"b", "b#2", f"b{t.LEVEL}#2"}


def plain_score(model, text):
    """The linear score by definition: every feature of the text, one by one."""
    words = (text or "").split()
    held = {}
    for w in words:
        for f in t.word_features(w):
            held[f] = held.get(f, 0) + 1
    found = set()
    for f, n in held.items():
        found.add(f)
        if n > 1:
            found |= {f"{f}{t.LEVEL}#{k}" for k in t.TIMES if n >= k} | {f"{f}{t.LEVEL}%{k}" for k in t.PER_MILLE if n / len(words) >= k / 1000}
    return sum(model.weights.get(f, 0.0) for f in found)


def test_scores_are_those_of_the_definition(monkeypatch):
    rng = random.Random(5)
    names = ["bad", "bad+", "wor+", "word", "sh#t", "x"]
    for memo in (2, 1000):
        monkeypatch.setattr(t, "MEMO", memo)
        weights = {n: rng.uniform(-2, 2) for n in names} | {f"{n}{t.LEVEL}{m}": rng.uniform(-1, 1) for n in names for m in ("#2", "#4", "%10", "%40") if rng.random() < 0.7}
        model = t.Ordinal(weights, [0.5, 1.5, 3.0])
        memo = t._Memo(model)
        for _ in range(200):
            text = " ".join(rng.choice(["bad", "Badly!", "word", "words", "sh#t", "x", "other", "*bad*", "wor"]) for _ in range(rng.randint(0, 60)))
            assert model.score(text, memo) == pytest.approx(plain_score(model, text)) == pytest.approx(model.score(text))
    assert model.score(None) == 0 and model.score("") == 0


def plain_loss(rows, grade, w, cut, ridge, grades):
    """The balanced negative log likelihood of the cumulative-link model, and the ridge."""
    share = np.bincount(grade, minlength=grades)
    weight = np.sqrt(len(grade) / share[grade] / (share > 0).sum())
    total = 0.0
    for r, g, b in zip(rows, grade, weight / weight.sum(), strict=True):
        at = lambda j, s=w[r].sum(): 0.0 if j < 0 else 1.0 if j == grades - 1 else 1 / (1 + np.exp(s - cut[j]))
        total -= b * np.log(at(g) - at(g - 1))
    return total + ridge * (w**2).sum() / 2 / len(rows)


def test_fit_is_the_least_loss():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(400)]
    s = np.array([np.array([1.5, 1.0, 0.5, 0.0, -1.0])[r].sum() for r in rows]) + rng.logistic(size=400)
    grade = np.searchsorted([0.5, 1.5, 3.0], s)
    w, cut = t.fit_ordinal(rows, grade, 5, ridge=2.0, steps=1500)
    least = plain_loss(rows, grade, w, cut, 2.0, 4)
    for k in range(5):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += d
            assert plain_loss(rows, grade, moved, cut, 2.0, 4) > least
    for k in range(3):
        for d in (-0.05, 0.05):
            moved = cut.copy()
            moved[k] += d
            assert plain_loss(rows, grade, w, moved, 2.0, 4) > least


def test_grades_come_from_the_other_half():
    rng = np.random.default_rng(6)
    strength = rng.integers(0, 4, 900)  # how many of three features a document has
    rows = [np.arange(k) for k in strength]
    toxic = rng.random(900) < np.array([0.02, 0.4, 0.8, 0.98])[strength]
    half = np.arange(900) % 2
    grade = t.grades_by_rank(rows, toxic, half, 3)
    assert (grade[~toxic] == 0).all() and set(grade[toxic].tolist()) == {1, 2, 3}
    for h in (0, 1):
        n = np.bincount(grade[toxic & (half == h)], minlength=4)[1:]
        assert n.max() - n.min() <= 1
        assert strength[toxic & (half == h) & (grade == 1)].mean() < strength[toxic & (half == h) & (grade == 3)].mean()
    few = t.grades_by_rank(rows[:4], np.array([True, True, False, False]), half[:4], 3)
    assert few.tolist() == [1, 1, 0, 0]


def test_sample_has_one_row_for_each_id(spark):
    docs = spark.createDataFrame([(7, f"text {i}", "x") for i in range(3000)] + [(8, None, "x"), (None, "no id", "x")] + [(100 + i, "a", "x") for i in range(30)], "doc_id long, text string, label string").repartition(6)
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (None, 1), (9, 1), *((100 + i, 0) for i in range(30))], "doc_id long, toxic int")
    for limit in (3, 10, 1000):
        got = _common.labelled_sample(docs, labels, "toxic", limit).collect()
        assert len(got) == len({r.doc_id for r in got}) <= limit
    assert {r.doc_id: r.label for r in got}[7] == 1 and len(got) == 32
    again = _common.labelled_sample(docs.repartition(2), labels, "toxic", 1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_sample_that_teaches_nothing_rejects_nothing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(30)), int(i % 9 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    for labelled in (rows, rows[:12]):
        labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int")
        model = t.learn_toxicity(docs, labels)
        assert sum(r.toxic for r in t.score_toxicity(docs, model).collect()) <= 3


def test_threshold_has_the_fewest_errors_on_the_other_half():
    rng = np.random.default_rng(4)
    toxic = rng.random(600) < 0.2
    rows = [np.array([0] if t and rng.random() < 0.95 else [1]) for t in toxic]
    half = np.arange(600) % 2
    grade = t.grades_by_rank(rows, toxic, half, 2)
    at = t.reject_threshold(rows, grade, half, 2)
    w, cut = t.fit_ordinal(rows, grade, 2)
    severity = t.severities(rows, w, cut)
    assert ((severity >= at) == np.array([r[0] == 0 for r in rows])).all()
    assert severity[0] == pytest.approx(sum(t.Ordinal({}, cut.tolist()).severity(float(w[rows[0]].sum()))))
    assert t.reject_threshold(rows, np.zeros(600, int), half, 2) == t.REJECT_AT  # nothing to reject: no error anywhere
    for grade in (toxic.astype(int), 3 * toxic.astype(int)):  # no features: nothing can be told apart
        none = [np.zeros(0, int)] * 600
        w, cut = t.fit_ordinal(none, grade, 2)
        assert t.severities(none[:1], w, cut)[0] < t.reject_threshold(none, grade, half, 2)
