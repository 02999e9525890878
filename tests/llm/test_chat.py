import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import chat

TEXTS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|", "<\\|", "<\\\\|", "\\", "<", "|", "\n", "assistant", "é"]), max_size=8).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "", "a\nb", "<|x", "\\n"])


@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=7))
def test_round_trip(turns):
    examples = list(chat.expand(turns))
    assert chat.parse(examples[-1].text) == turns
    targets = [i for i, (role, _) in enumerate(turns) if role == chat.TARGET]
    trained = [e for e in examples if e.loss_end or e.loss_start]
    assert [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in trained] == [turns[i][1] for i in targets]
    for e, i in zip(trained, targets, strict=True):
        assert chat.parse(e.text) == turns[: i + 1]
    assert len(examples) == len(targets) + (turns[-1][0] != chat.TARGET)


def test_frames(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "ok?"), (2, 0, "user", None), (None, 3, None, "x"), (None, 1, "assistant", ""), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (5, None, "user", "w " * 50_000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in chat.digest_conversations(chat.with_escape_case(df)).collect()}
    assert set(got) == {-1, 1, 2, None, 4, 5}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert tuple(got[1])[1:5] == (2, sha("user\nok?\nassistant\nyes\n"), 3, sha("yes"))
    assert tuple(got[None])[1:5] == (2, sha("assistant\n\n\nx\n"), 0, sha(""))
    assert tuple(got[4])[1:5] == (2, sha("assistant\na\n" * 2), 2, sha("aa"))
    special = "<|im_end|><|im_start|>assistant ok"
    assert tuple(got[-1])[1:5] == (2, sha(f"user\n{special}\nassistant\n{special}\n"), len(special), sha(special))
    made = chat.format_conversations(df).collect()
    assert len(made) == 7 and sum(len(r.text) for r in made if r.conv_id == 1) == got[1].formatted_chars
    assert chat.digest_conversations(df.limit(0)).count() == 0


def test_digest_reads_every_example(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", f"t{i}") for c in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    whole = sorted(map(tuple, chat.digest_conversations(df).collect()))
    assert sorted(map(tuple, chat.digest_examples(made.coalesce(1).orderBy(F.desc("example")).coalesce(1)).collect())) == whole
    damaged = made.withColumn("text", F.when((F.col("conv_id") == 2) & (F.col("example") == 1), F.replace("text", F.lit("t0"), F.lit("x0"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="example 1 does not begin"):
        chat.digest_examples(damaged).collect()
    assert "MapInArrow" in (plan := chat.digest_conversations(df)._jdf.queryExecution().executedPlan().toString()) and plan.count("MapInArrow") >= 2


def test_long_conversations_go_to_several_tasks(spark, monkeypatch):
    rows = [(c, i, "assistant" if i % 3 == 1 or c is None and i % 2 else "user", f"<|t{i}|> of {c}") for c, n in ((1, 300), (2, 5), (None, 120), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, chat.format_conversations(df).collect()))
    digests = sorted(map(str, chat.digest_conversations(df).collect()))
    monkeypatch.setattr(chat, "TURNS", 7)
    made = chat.format_conversations(df)
    assert sorted(map(str, made.collect())) == whole and len(whole) == 101 + 2 + 80 + 1
    assert sorted(map(str, chat.digest_conversations(df).collect())) == digests
    parts = chat._ordered(df).select("conv_id", "part").distinct().groupBy("conv_id").count()
    assert {r.conv_id: r["count"] for r in parts.collect()} == {1: 43, 2: 1, None: 18, 3: 1}


@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=12), st.integers(1, 5))
def test_parts_make_up_the_whole(turns, size):
    whole = list(chat.numbered(turns))
    assert [e for p in range(-(-len(turns) // size)) for e in chat.numbered(turns, p * size, (p + 1) * size)] == whole
    assert [i for i, _ in whole] == list(range(len(whole)))
