import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, node long, token long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_rows():
    """Documents with copies, near copies, nulls in every column, empty and long texts, ties."""
    rng = random.Random(5)
    out = []
    base = [words(rng, rng.choice([3, 12, 60, 200])) for _ in range(30)]
    for i, t in enumerate(base):
        out.append((i, t, "en", f"s{i % 4}", len(t)))
        if i % 3 == 0:
            out.append((100 + i, t, "en", "s0", len(t)))
        if i % 2 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            out.append((200 + i, " ".join(w).upper() if i % 4 else "  ".join(w), None, None, None))
    out += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t ", "en", "s1", 4), (303, "one", "en", "s2", 3), (304, "ONE", "en", "s2", 3), (5, base[5], "en", "s1", 1), (None, base[2], "en", "s1", 1), (None, "no id but text of its own here", "en", None, 1), (305, words(rng, 20_000), "en", "s3", 1), (306, "x" * 600_000, "en", "s3", 1), (307, "é\u00a0ü\u2003z " * 5, "fr", "s3", 1)]
    return [(*r, None, None, None) for r in out]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
