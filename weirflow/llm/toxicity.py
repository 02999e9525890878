"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's features are the words of its whole text and their beginnings, with levels of how
often each is found.  One
weight vector is shared by all thresholds: P(grade <= j) = sigmoid(threshold_j - w.x) with
ordered thresholds, and the expected severity is the sum of P(grade > j).

The labels say toxic or not, so the grades come from what the labels leave to be learned: two
models are fitted on one half of the sample each, and the toxic documents of the other half are
ranked by their scores there.  A document that is not toxic has grade 0; the toxic ones of each half, by
rank in equal parts, 1 to ``GRADES`` - 1.  The ordinal model is then fitted on all.

Candidate features are counted and selected with Spark on at most ``LABELLED_DOCS`` labelled
rows, one for each id: those that ``LEAST_DOCS`` toxic documents hold at least and that speak for
toxicity; ``MAX_FEATURES`` of them reach the driver.  These are parameters of the model, chosen
on labels that neither fitted it nor are reported; README.md tells their effect.

Defined results: a null or empty text has no features and gets the severity of an empty
document; without labels of both kinds the severity is 0 everywhere; repeated rows are judged
alike; a text of any length is read whole; an empty table gives an empty result; columns other
than the id, text and those kept are not read, so extra ones may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Generations, labelled_sample, map_rows, scratch, stored

LABELLED_DOCS = 20_000
MAX_FEATURES = 256
#: Toxic documents of the sample that must hold a feature.
LEAST_DOCS = 8
GRADES = 4
#: A document whose expected severity reaches this is toxic, unless another threshold has fewer errors
#: on documents of the sample that the model has not seen; the last one rejects nothing.
REJECT_AT = 0.4
THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0, 4.0)
#: Ridge on the weights.
RIDGE = 0.1
#: Entries in a generation of a worker's memo of words.
MEMO = 100_000
#: Levels of a feature's count in a document, and of its share in thousandths of the words.
TIMES = (2, 3, 4, 6, 8)
PER_MILLE = (5, 10, 20, 40)
#: Between a word or beginning and its level: white space, which no word holds.
LEVEL = " "
EDGES = ".,;:!?\"'()[]{}*$%&#|<>-_"


def word_features(word: str) -> tuple[str, ...]:
    """A word's own feature and those of its beginnings."""
    return _beginnings(word.strip(EDGES).lower())


def _beginnings(w: str) -> tuple[str, ...]:
    return (w, *(f"{w[:n]}+" for n in range(3, 9) if len(w) > n)) if w else ()


def levels(counts: dict[str, int], words: int) -> set[str]:
    """Features of a document from how often it holds each word or beginning: present, so many
    times, and so large a part of its words."""
    out = set(counts)
    for f, n in counts.items():
        if n >= 2:
            out.update(f"{f}{LEVEL}#{k}" for k in TIMES if n >= k)
            out.update(f"{f}{LEVEL}%{k}" for k in PER_MILLE if 1000 * n >= k * words)
    return out


@dataclass
class Ordinal:
    """Weights by feature, ordered thresholds, and the expected severity from which on a document is toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    reject_at: float = REJECT_AT

    def severity(self, s: float) -> list[float]:
        """P(grade > j) for each threshold at the linear score ``s``."""
        return [1 / (1 + float(np.exp(min(700.0, t - s)))) for t in self.thresholds]

    def found(self, text: str | None, memo: _Memo) -> list[str]:
        """The features of a whole text that have a weight, in an order that depends on them alone."""
        words = (text or "").split()
        counts: dict[str, int] = {}
        starts = memo.starts
        for word, k in Counter(words).items():
            plain = word.strip(EDGES).lower()
            if plain[:3] in starts:
                for f in memo[plain]:
                    counts[f] = counts.get(f, 0) + k
        out, n = [], len(words)
        for f in sorted(counts):
            k = counts[f]
            present, times, shares = memo.parts[f]
            out += present
            if k >= 2:
                out += [name for least, name in times if k >= least]
                out += [name for least, name in shares if 1000 * k >= least * n]
        return out

    def score(self, text: str | None, memo: _Memo | None = None) -> float:
        """The linear score of a whole text."""
        return sum(map(self.weights.__getitem__, self.found(text, _Memo(self) if memo is None else memo)), 0.0)


class _Memo(Generations):
    """Word, as ``word_features`` strips it, to those of its features that have a weight, alone or with a level."""

    def __init__(self, model: Ordinal):
        super().__init__(MEMO)
        #: By word or beginning: its features alone, and (level, feature) by times and by share.
        self.parts: dict[str, tuple[tuple, tuple, tuple]] = {}
        for base in {f.split(LEVEL)[0] for f in model.weights}:
            at = lambda mark, ks, base=base: tuple((k, f) for k in ks if (f := f"{base}{LEVEL}{mark}{k}") in model.weights)
            self.parts[base] = (base,) if base in model.weights else (), at("#", TIMES), at("%", PER_MILLE)
        #: How words with such features begin: beginnings have three characters at least.
        self.starts = {base[:3] for base in self.parts}

    def make(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in _beginnings(word) if f in self.parts)


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, size: int, *, grades: int = GRADES, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps (Adam) on the cumulative-link likelihood.

    ``rows`` hold the indexes of each document's features.  The thresholds are a first value and
    the logarithms of the gaps, so they stay ordered.  The loss of each grade is weighted alike.
    """
    lengths = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), lengths)
    col = np.concatenate(rows).astype(int) if len(rows) else np.zeros(0, int)
    share = np.bincount(grade, minlength=grades)
    balance = np.sqrt(len(grade) / np.maximum(share, 1) / max((share > 0).sum(), 1))[grade]
    balance /= balance.sum()
    theta = np.concatenate([np.zeros(size), [1.0], np.zeros(grades - 2)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cut = theta[:size], np.concatenate([[theta[size]], np.exp(theta[size + 1 :])]).cumsum()
        s = np.bincount(doc, weights=w[col], minlength=len(rows))
        below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-50.0], cut, [50.0]])[None, :] - s[:, None], -50, 50)))
        n = np.arange(len(rows))
        upper, lower = below[n, grade + 1], below[n, grade]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * balance, lower * (1 - lower) / p * balance
        ds = du - dl  # of the negative log likelihood by the score
        grad_w = np.bincount(col, weights=ds[doc], minlength=size) + ridge * w / max(len(rows), 1)
        grad_cut = np.zeros(grades + 1)
        np.add.at(grad_cut, grade + 1, -du)
        np.add.at(grad_cut, grade, dl)
        grad_cut = grad_cut[1:-1]
        tail = grad_cut[::-1].cumsum()[::-1]
        grad = np.concatenate([grad_w, [tail[0]], tail[1:] * np.exp(theta[size + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:size], np.concatenate([[theta[size]], np.exp(theta[size + 1 :])]).cumsum()


def document_features(text: str | None) -> set[str]:
    words = (text or "").split()
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        for f in word_features(w):
            counts[f] += n
    return levels(counts, len(words))


def grades_by_rank(rows: list[np.ndarray], toxic: np.ndarray, half: np.ndarray, size: int, grades: int = GRADES, ridge: float = RIDGE) -> np.ndarray:
    """0 for what is not toxic, else 1 to ``grades`` - 1 by the rank of the score that a model of
    the other half gives."""
    out = np.where(toxic, 1, 0)
    for h in (0, 1):
        other, own = np.flatnonzero(half != h), np.flatnonzero((half == h) & toxic)
        if len(own) < grades - 1 or not 0 < toxic[other].sum() < len(other):
            continue
        w, _ = fit_ordinal([rows[i] for i in other], toxic[other].astype(int), size, grades=2, ridge=ridge)
        score = np.array([w[rows[i]].sum() for i in own])
        rank = np.empty(len(own), int)
        rank[np.argsort(score, kind="stable")] = np.arange(len(own))
        out[own] = 1 + rank * (grades - 1) // len(own)
    return out


def severities(rows: list[np.ndarray], w: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The expected severity of each of ``rows``."""
    s = np.array([w[r].sum() for r in rows])
    return (1 / (1 + np.exp(np.clip(cut[None, :] - s[:, None], -50, 50)))).sum(axis=1)


def reject_threshold(rows: list[np.ndarray], grade: np.ndarray, half: np.ndarray, size: int, ridge: float = RIDGE) -> float:
    """Of THRESHOLDS the one with the fewest errors when each half is judged by a model of the
    other; of equals the nearest to REJECT_AT.  So a sample that teaches nothing rejects nothing."""
    found = np.zeros(len(rows))
    for h in (0, 1):
        other, own = np.flatnonzero(half != h), np.flatnonzero(half == h)
        if len(own) and 0 < (grade[other] > 0).sum() < len(other):
            w, cut = fit_ordinal([rows[i] for i in other], grade[other], size, ridge=ridge)
            found[own] = severities([rows[i] for i in own], w, cut)
    errors = {t: int(((found >= t) != (grade > 0)).sum()) for t in THRESHOLDS}
    return min(THRESHOLDS, key=lambda t: (errors[t], abs(t - REJECT_AT), t))


def learn_toxicity(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_DOCS, most: int = MAX_FEATURES, least: int = LEAST_DOCS, ridge: float = RIDGE) -> Ordinal:
    """The model fitted on at most ``limit`` labelled documents; only feature indexes reach the driver."""

    def count():
        def rows(batch: dict[str, list]) -> Iterator[tuple]:
            total: dict[str, list[int]] = {}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for f in document_features(text):
                    total.setdefault(f, [0, 0])[label > 0] += 1
            for f, (clean, toxic) in total.items():
                yield f, clean, toxic

        return rows

    with scratch():
        sample = stored(labelled_sample(docs, labels, "toxic", limit), "sample")
        sizes = {r.label: r.n for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes.get(1) or not sizes.get(0):
            return Ordinal()
        counts = map_rows(sample, count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
        picked = counts.where(F.col("toxic") >= least).select("f", odds.alias("odds"), "toxic").where("odds > 1")
        picked = picked.orderBy((F.col("odds") * F.col("toxic")).desc(), "f").limit(most).collect()
        index = {r.f: i for i, r in enumerate(picked)}

        candidates = Ordinal(dict.fromkeys(index, 1.0))

        def encode():
            memo = _Memo(candidates)

            def rows(batch: dict[str, list]) -> Iterator[tuple]:
                for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                    yield doc_id, sorted(index[f] for f in candidates.found(text, memo)), label > 0

            return rows

        got = map_rows(sample, encode, "doc_id long, f array<int>, toxic boolean").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))).toArrow().sort_by("doc_id")
    rows = [np.array(r, dtype=int) for r in got["f"].to_pylist()]
    grade = grades_by_rank(rows, got["toxic"].to_numpy(), got["half"].to_numpy(), len(index), ridge=ridge)
    w, cut = fit_ordinal(rows, grade, len(index), ridge=ridge)
    reject_at = reject_threshold(rows, grade, got["half"].to_numpy(), len(index), ridge)
    return Ordinal({r.f: float(w[i]) for i, r in enumerate(picked) if abs(w[i]) > 1e-4}, cut.tolist(), reject_at)


def score_toxicity(docs: DataFrame, model: Ordinal, keep: str = "doc_id long", reject_at: float | None = None) -> DataFrame:
    """Expected severity, likeliest grade and verdict for every row of ``docs``."""
    reject_at = model.reject_at if reject_at is None else reject_at
    columns = [c.split()[0] for c in keep.split(",")]

    def make():
        memo = _Memo(model)

        def rows(batch: dict[str, list]) -> Iterator[tuple]:
            for i, text in enumerate(batch["text"]):
                above = model.severity(model.score(text, memo))
                chances = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
                expected = float(sum(above))
                yield *(batch[c][i] for c in columns), expected >= reject_at, expected, chances.index(max(chances))

        return rows

    return map_rows(docs.select(*dict.fromkeys([*columns, "text"])), make, f"{keep}, toxic boolean, severity double, grade int")
