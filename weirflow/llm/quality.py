"""Quality rules: base rules on word statistics, then gradient-boosted trees.

Every whole text becomes a row of statistics.  The base rules reject a text with under
``MIN_WORDS`` words or with over ``MAX_REPEAT_PERCENT`` percent of its words in repeated
five-word windows.  Trees boosted on labelled statistics judge the rest.  They are complete
binary trees held in numpy arrays (feature, threshold, leaf value), so a block of documents is
scored level by level without a Python loop over documents.  Features named in
``DECREASING`` can only lower the score: a split that would break this is not taken and leaf
values are held between the bounds of their branch.

The trees are fitted on at most ``LABELLED_DOCS`` labelled rows (a parameter), one for each id.
Without both labels in the sample no tree is grown and the base rules decide alone.

Defined results: a null text counts as one without words and fails the base rules, and so does
an empty one; a score of just the threshold is kept; repeated rows are judged alike; a text of
any length is read whole; an empty table gives an empty result; columns other than the id, text
and those kept are not read, so extra ones may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ._common import SPACES, labelled_sample, map_rows

LABELLED_DOCS = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"

FEATURES = ("log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "bar_ratio", "shout_ratio", "upper_ratio", "digit_ratio", "distinct_ratio", "mean_line", "mark_ratio")
#: Features that may only lower the score.
DECREASING = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "bar_ratio", "shout_ratio", "upper_ratio")


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    return (*_counts(text, words),)


def _counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more, its first place included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def features(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base statistics and the trees' features of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, chars, symbols, dup, repeated = base = _counts(text, words)
    lines = text.count("\n") + 1
    some, size = max(n, 1), max(chars, 1)
    upper = sum(w.isupper() for w in words)
    return base, [
        float(np.log1p(n)),
        chars / some,
        symbols / size,
        dup / lines,
        repeated / some,
        text.count("|") / some,
        text.count("!") / some,
        upper / some,
        sum(map(text.count, "0123456789")) / size,
        len(set(words)) / some,
        n / lines,
        sum(map(text.count, ".,;:?")) / some,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: feature and threshold by (tree, inner node),
    value by (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for the rows of ``x``."""
        if not len(self.value):
            return np.full(len(x), self.base)
        inner = self.feature.shape[1]
        tree = np.arange(len(self.feature))
        node = np.zeros((len(x), len(tree)), dtype=np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.value[tree, node - inner].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5, decreasing: tuple[int, ...] = ()) -> Trees:
    """Boost regression trees on the logistic loss (second order, histograms of quantile bins)."""
    inner, leaves = 2**depth - 1, 2**depth
    empty = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if len(y) == 0 or y.min() == y.max():
        return empty
    base = float(np.log(y.mean() / (1 - y.mean())))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)
    width = max(len(c) for c in cuts) + 1
    sign = np.zeros(x.shape[1])
    sign[list(decreasing)] = -1
    score = np.full(len(y), base)
    feature, threshold, value = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        f, t, v = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(len(y), int)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            found = _best_split(binned[rows], g[rows], h[rows], width, cuts, sign, (low[k], high[k]), ridge, least)
            for child in (2 * k + 1, 2 * k + 2):
                low[child], high[child] = low[k], high[k]
            if found:
                f[k], cut, left, right = found
                t[k] = cuts[f[k]][cut]
                if sign[f[k]] < 0:  # everything left of the cut stays above everything right of it
                    middle = (left + right) / 2
                    low[2 * k + 1], high[2 * k + 2] = max(low[k], middle), min(high[k], middle)
                node[rows] = 2 * k + 1 + (binned[rows, f[k]] > cut)
            else:
                node[rows] = 2 * k + 1
        for leaf in range(leaves):
            rows = node == inner + leaf
            w = -g[rows].sum() / (h[rows].sum() + ridge)
            v[leaf] = rate * float(np.clip(w, low[inner + leaf], high[inner + leaf]))
        score += v[node - inner]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(np.array(feature), np.array(threshold), np.array(value), base)


def _best_split(b, g, h, width, cuts, sign, bounds, ridge, least):
    if len(g) < 2 * least:
        return None
    total_g, total_h = g.sum(), h.sum()
    best, found = 1e-6, None
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        n = np.bincount(b[:, j], minlength=width).cumsum()[: len(cut)]
        gl = np.bincount(b[:, j], weights=g, minlength=width).cumsum()[: len(cut)]
        hl = np.bincount(b[:, j], weights=h, minlength=width).cumsum()[: len(cut)]
        gr, hr = total_g - gl, total_h - hl
        left, right = np.clip(-gl / (hl + ridge), *bounds), np.clip(-gr / (hr + ridge), *bounds)
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
        fits = (n >= least) & (len(g) - n >= least)
        if sign[j]:
            fits &= sign[j] * (right - left) >= 0
        gain = np.where(fits, gain, 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k, left[k], right[k])
    return found


def learn_quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_DOCS) -> Trees:
    """Trees fitted on at most ``limit`` labelled documents; only their statistics reach the driver."""

    def make():
        def rows(batch: dict[str, list]) -> Iterator[tuple]:
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                yield doc_id, features(text)[1], label

        return rows

    got = map_rows(labelled_sample(docs, labels, "quality", limit), make, "doc_id long, x array<double>, y int").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))[order]
    y = got["y"].to_numpy().astype(float)[order]
    return fit_trees(x, y, decreasing=tuple(map(FEATURES.index, DECREASING)))


def judge_quality(docs: DataFrame, trees: Trees, keep: str = "doc_id long", threshold: float = 0.0) -> DataFrame:
    """Judge every row of ``docs``: the base statistics, base_failed, kept and the trees' score.

    ``keep`` names the columns (with types) that are passed through.
    """
    columns = [c.split()[0] for c in keep.split(",")]

    def make():
        def rows(batch: dict[str, list]) -> Iterator[tuple]:
            made = [features(t) for t in batch["text"]]
            score = trees.score(np.array([x for _, x in made], dtype=float).reshape(-1, len(FEATURES)))
            for i, ((base, _), s) in enumerate(zip(made, score.tolist(), strict=True)):
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                yield *(batch[c][i] for c in columns), *base, failed, not failed and s >= threshold, s

        return rows

    schema = f"{keep}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return map_rows(docs.select(*dict.fromkeys([*columns, "text"])), make, schema)
