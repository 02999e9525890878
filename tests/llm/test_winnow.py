import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import winnow as w


def test_choices_are_the_rightmost_least():
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("abé🙂") for _ in range(rng.randint(1, 150)))
        k, window = 4, 6
        grams = [text[i : i + k] for i in range(len(text) - k + 1)] or [text]
        hashes = {}
        for g in set(grams):
            hashes[g] = int(w.winnow(g, k, 1)[0][0])
        h = [hashes[g] for g in grams]
        want = {}
        for i in range(max(1, len(h) - window + 1)):
            span = range(i, min(i + window, len(h)))
            at = min(span, key=lambda p: (h[p] >> 16, -p))
            want[at] = h[at]
        got = w.winnow(text, k, window)
        assert dict(zip(got[1].tolist(), got[0].tolist(), strict=True)) == want


def test_common_passages_are_found():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(50):
        shared = letters(w.K + w.WINDOW - 1)
        a, b = letters(rng.randint(0, 300)) + shared + letters(200), letters(rng.randint(0, 300)) + shared + letters(100)
        assert len(np.intersect1d(w.winnow(a)[0], w.winnow(b)[0]))


def test_likeness():
    none = w.winnow(None)[0]
    some = w.winnow("a text that is long enough to have several fingerprints, at least two or so")[0]
    assert w.likeness(none, none) == 1 and w.likeness(none, some) == 0 and w.likeness(some, some) == 1


def mark(text):
    """The hash that orders rows of one id."""
    h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return h - (h >> 63 << 64)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1]), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        f, g, h = (w.winnow(t) for t in (text, new, following))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), w.written(*f), w.written(*g), w.likeness(f[0], g[0]), w.likeness(f[0], h[0])))
    return sorted(map(str, out))


def test_frame(spark, awkward, empty):
    got = sorted(str(tuple(r)) for r in w.fingerprint_documents(awkward).collect())
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert w.fingerprint_documents(empty).count() == 0
    for rows in ([(1, "only one text, which follows itself")], [(1, "a"), (2, "b" * 50)], [(7, "x y z")] * 4, [(None, "p"), (None, None)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(str(tuple(r)) for r in w.fingerprint_documents(df).collect()) == brute(rows)


def test_last_third_of_a_near_text(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randint(0, 10**6)) for _ in range(200))) for i in range(20)]
    for r in w.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.near_edited > 0.55 and r.near_next < 0.1


def test_pieces_of_long_texts_meet():
    rng = random.Random(4)
    text = "".join(rng.choice("abcde") for _ in range(3000)) + "z" * 500
    whole = w.winnow(text)
    h = [int(w.winnow(text[i : i + w.K], w.K, 1)[0][0]) for i in range(len(text) - w.K + 1)]
    want = sorted({min(range(i, i + w.WINDOW), key=lambda p: (h[p] >> 16, -p)) for i in range(len(h) - w.WINDOW + 1)})
    assert whole[1].tolist() == want and whole[0].tolist() == [h[p] for p in want]
    long = "some words of a text " * 30_000  # ten pieces
    h, at = w.winnow(long)
    assert (np.diff(at) > 0).all() and (np.diff(at) <= w.WINDOW).all() and at[-1] >= len(long) - w.K - w.WINDOW
    part = w.winnow(long[210_000:])
    assert set(zip(part[0].tolist(), (part[1] + 210_000).tolist(), strict=True)) - set(zip(h.tolist(), at.tolist(), strict=True)) <= {(a, b + 210_000) for a, b in zip(part[0][:2].tolist(), part[1][:2].tolist(), strict=True)}


def test_common_ids_have_several_ranges(spark):
    rows = [(7 if i % 3 else None if i % 2 else i, f"text {i} of many rows with one id, long enough") for i in range(600)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (-(1 << 63), "least again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = w.in_descending_ranges(df, 24)
    sizes = {r.part: r.n for r in placed.where("lead = 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 100
    assert placed.where("lead = 1").groupBy("part").count().where("count > 1").count() == 0
    assert sorted(str(tuple(r)) for r in w.fingerprint_documents(df).collect()) == brute(rows)
