import random
import re
from collections import Counter

import numpy as np

from weirflow.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_statistics():
    rng = random.Random(1)
    texts = [None, "", " \x0b\x0c", "a a a a a a", "a b c d e\na b c d e", "é\u00a0b | # x", "\x1c\x85 w"]
    texts += [" ".join(rng.choice("ab\n|é") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for t in texts:
        assert q.base_statistics(t) == brute(t), t


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2)).astype(float)
    trees = q.fit_trees(x[:2000], y[:2000], decreasing=(0,))
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    line = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
    line[:, :, 0] = np.linspace(0, 1, 40)
    assert (np.diff(trees.score(line.reshape(-1, 3)).reshape(50, 40), axis=1) <= 1e-12).all()


def test_flat_arrays_score_like_walking_the_trees():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    trees = q.fit_trees(x, y, rounds=5)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        return total

    assert np.allclose(trees.score(x), [walk(r) for r in x])


def test_frame_without_labels(spark, awkward, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    trees = q.learn_quality(awkward, labels)
    got = q.judge_quality(awkward, trees).collect()
    texts = awkward.collect()
    want = sorted(str((r.doc_id, *brute(r.text))) for r in texts)
    assert sorted(str(tuple(r)[:6]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert q.judge_quality(empty, trees).count() == 0


def test_labels_decide_and_odd_rows_do_not_matter(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 97} of" for k in range(40)) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(f"word{(i * 5 + k) % 97}$$$ |" for k in range(40))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad if i % 2] + [(None, 1, 0), (5, None, None), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    trees = q.learn_quality(docs, labels)
    kept = {r.doc_id: (r.kept, r.base_failed) for r in q.judge_quality(docs, trees).collect()}
    assert all(k == (i < 100) for i, (k, failed) in kept.items() if not failed)
