import random

import numpy as np
from pyspark.sql import functions as F

from weirflow.llm import _common
from weirflow.llm import ngram_join as j
from weirflow.llm._shingles import shingle_set

from .conftest import awkward_rows, words


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [brute_set(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                group[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(str((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def got(df):
    return sorted(str(tuple(r)) for r in j.join_components(df).collect())


def test_sets_are_those_of_words():
    for r in awkward_rows():
        assert len(shingle_set(r[1])) == len(brute_set(r[1]))
    assert (shingle_set("a b c d E") == shingle_set(" A\tb\nc d\x0be ")).all()
    assert len(shingle_set("É b")) == 1 and (shingle_set("É b") != shingle_set("é b")).all()
    assert (shingle_set("ab c") != shingle_set("a bc")).all()


def test_awkward_rows(awkward, empty):
    assert got(awkward) == brute(awkward_rows())
    assert got(empty) == []


def test_near_copies_and_shared_passages(spark):
    rng = random.Random(9)
    passage = words(rng, 60)
    rows = [(i, words(rng, rng.randint(40, 120)) + (" " + passage if i % 3 == 0 else "")) for i in range(120)]
    base = rows[0][1].split()
    for i in range(150):  # a group of near copies around the limit
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)


def test_every_link_is_found_once(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 50)) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail" * k) for i in range(20) for k in (1, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, links = j.link_classes(df, all_pairs=True)
    node = {r.node: r.doc_id for r in sets.frame.select("node", "doc_id").collect()}
    found = [tuple(sorted((r.a, r.b))) for r in links.frame.collect()]
    by_node = {n: brute_set(dict(rows)[d]) for n, d in node.items()}
    nodes = sorted(by_node)
    want = {(a, b) for i, b in enumerate(nodes) for a in nodes[:i] if 100 * len(by_node[a] & by_node[b]) >= 80 * len(by_node[a] | by_node[b])}
    assert len(found) == len(set(found)) and set(found) == want


def test_prefixes_of_linked_sets_meet(spark):
    """Prefixes, positions included, against counting all shingles by definition."""
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([6, 9, 30, 80]))) for i in range(40)]
    rows += [(100 + i, t + " and a few more words") for i, t in rows] + [(200 + i, "some common beginning of words here " + words(rng, 12)) for i in range(150)]
    got = j.document_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    node = {r.node: r.n_shingles for r in got if r.key is not None}
    assert sorted(r.doc_id for r in got if r.key is not None) == sorted(i for i, _ in rows)
    prefixes = {}
    for r in got:
        if r.token is not None:
            assert 0 <= r.pos < j.prefix_length(r.n_shingles) and node[r.node] == r.n_shingles
            prefixes.setdefault(r.node, set()).add(r.token)
    sets = {j._node(s): s for s in (shingle_set(t) for _, t in rows)}
    linked = [(a, b) for a in sets for b in sets if a < b and j.linked(sets[a], sets[b])]
    assert len(linked) > 10 and all(prefixes[a] & prefixes[b] for a, b in linked)


def test_a_word_has_one_hash_whatever_is_beside_it():
    for n in (j.column_sets.__globals__["SLICE"] * k + d for k in (1, 2, 3) for d in (-1, 0, 1)):
        long = "a" * n
        alone = shingle_set(long)
        for other in (long + " ", " " + long, "\n" * 7 + long + "\t" * 9, long.upper()):
            assert (shingle_set(other) == alone).all(), n
        inside = f"one two {long} three four five"
        assert (shingle_set(inside) == shingle_set(inside.replace(" ", "  ") + " " * 600_000)).all() and len(shingle_set(inside)) == 2


def test_profiles_bound_the_difference():
    rng = np.random.default_rng(1)
    for size in (3, 500, 9000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, size // 9 + 1, dtype=np.uint64)])
        x, y = (np.frombuffer(j._profile(s), np.uint8) for s in (a, b))
        assert 0 <= j._apart(x, y) <= len(np.setxor1d(a, b)) and j._apart(x, x) == 0


def test_only_what_the_result_reads_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_root", lambda s: f"file://{tmp_path}")
    out = j.join_components(spark.createDataFrame([(i, "one two three four five six" + " x" * (i % 3)) for i in range(30)], "doc_id long, text string"))
    assert out.where("component_id > 2").count() == 0
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["documents", "labels"]


def test_one_of_each(spark, awkward):
    kept = j.one_of_each(awkward)
    rows = awkward.join(j.join_components(awkward).distinct(), "doc_id")
    want = rows.where((F.col("component_id") == F.col("doc_id"))).select("doc_id").distinct().count()
    assert kept.where("doc_id is not null").count() == want
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["no id but text of its own here"]
    assert kept.columns == awkward.columns
