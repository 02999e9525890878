"""Hashes of words and of five-word shingles, many texts at a time in numpy.

A word's hash is a polynomial of its bytes (each byte stands for a fixed random number, A-Z for
that of a-z), so the hashes of all words of a buffer come from one running sum: no Python object
per word.  A shingle's hash mixes those of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

NGRAM = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes that are hashed at once; a longer text is cut between words.
SLICE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b + 32 if 65 <= b <= 90 else b])) | 1 for b in range(256)], dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses up to ``n``."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIXER
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a buffer of bytes and where they start; no word goes over a break."""
    if len(data) > 2 * SLICE:
        return _cut(data, breaks)
    space = _SPACE[data]
    begin, stop = ~space, ~space
    begin[1:] &= space[:-1]
    stop[:-1] &= space[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    begin[inner] = ~space[inner]
    stop[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    powers, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts]), starts


def _cut(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of a long buffer in pieces that end after white space."""
    found, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            back = np.flatnonzero(_SPACE[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one word is longer than a piece: go on to its end
                ahead = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(data)
        h, s = _whole(data[at:end], breaks[(breaks >= at) & (breaks < end)] - at)
        found.append((h, s + at))
        at = end
    return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])


def _whole(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(data) <= 2 * SLICE:
        return word_hashes(data, breaks)
    # a word of megabytes between two breaks: the same sum as in word_hashes, by pieces
    powers, _ = _power_tables(SLICE)
    edges = [0, *breaks[(breaks > 0)].tolist(), len(data)]
    h, s = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        raw = data[a:b]
        kept = np.flatnonzero(~_SPACE[raw])
        if len(kept):
            word, total = raw[kept[0] : kept[-1] + 1], 0
            for at in range(0, len(word), SLICE):
                piece = word[at : at + SLICE]
                total += pow(_BASE, at, 1 << 64) * int((_BYTE[piece] * powers[: len(piece)]).sum(dtype=np.uint64))
            h.append(total & 0xFFFFFFFFFFFFFFFF)
            s.append(a + int(kept[0]))
    return mixed(np.array(h, dtype=np.uint64)), np.array(s, dtype=np.int64)


def _combine(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(h) - size + 1
    total = h[:n].copy()
    for k in range(1, size):
        total *= MULTIPLIER
        total += h[k : k + n]
    return mixed(total + np.uint64(size))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def sets_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text between two offsets of a buffer."""
    h, starts = word_hashes(data, offsets)
    first = np.searchsorted(starts, offsets)
    grams = _combine(h, NGRAM) if len(h) >= NGRAM else h[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= NGRAM:
            yield _distinct(grams[a : b - NGRAM + 1])
        else:
            yield _combine(h[a:b], n) if n else h[:0]


def column_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle sets of a string column's texts, in order; null is empty."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
        stop = min(stop, len(column))
        yield from sets_of(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return next(sets_of(data, np.array([0, len(data)])))
