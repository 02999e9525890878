import os
import time

import pytest
from pyspark.sql import functions as F

from weirflow import types as t
from weirflow.errors import SchemaError, StreamTimeout
from weirflow.operators import AddColumn, Collect, Custom, Filter, FlatMap, Map, Reduce, RemoveColumn, RenameColumn, Repartition, RepartitionReduce, key_columns
from weirflow.plans import queries
from weirflow.schema import create_schema
from weirflow.sources import JSONL
from weirflow.streaming import BATCH, generator_source, run_stream, stream_pipeline

DIR = "/root/testdata/sf0.01"


def pipeline(spark, limit, name):
    lines = generator_source(spark, [lambda k, g=g: f'{{"col1": {(k + g) % 10}}}' for g in range(4)], 12, limit, name)
    p = stream_pipeline(lines, JSONL(), create_schema(col1=t.Int32))
    return p.to(AddColumn("n", t.Int64), Map({"n": F.lit(1)}), Reduce(F.lit(1), {"n": F.sum("n")}))


def test_each_batch_is_reduced_on_its_own(spark):
    seen = []
    run_stream(pipeline(spark, 3, "three"), lambda df, number: seen.append([r.n for r in df.collect()]), available=True)
    assert seen == [[48], [48], [48]]


def test_timeout_and_collect(spark):
    p = pipeline(spark, None, "endless")
    seen = []
    with pytest.raises(StreamTimeout):
        run_stream(p, lambda df, number: seen.append(df.count()), timeout=4)
    assert seen
    with pytest.raises(SchemaError):
        p.to(Collect(1))


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    place, seen = f"file://{tmp_path}/checkpoint", []

    def source(limit):
        lines = generator_source(spark, [lambda k, g=g: f'{{"col1": {10 * k + g}}}' for g in range(2)], 3, limit, checkpoint=place)
        return stream_pipeline(lines, JSONL(), create_schema(col1=t.Int32))

    def sink(df, number):
        seen.append((number, sorted(r.col1 for r in df.collect())))

    for limit in (2, 2, 4):
        run_stream(source(limit), sink, available=True, timeout=60, checkpoint=place)
    assert seen == [(b, sorted(10 * k + g for k in range(3 * b, 3 * b + 3) for g in range(2))) for b in range(4)]


def test_time_limit_holds_for_what_is_available(spark):
    def slow(df, number):
        time.sleep(1)

    began = time.time()
    with pytest.raises(StreamTimeout):
        run_stream(pipeline(spark, None, "unlimited"), slow, timeout=3, available=True)
    assert time.time() - began < 30


def test_sources_do_not_replace_each_other(spark):
    first, second = (generator_source(spark, [lambda k, n=n: f'{{"col1": {n}}}'], 2, 1) for n in (1, 2))
    seen = []
    for lines in (first, second):
        run_stream(stream_pipeline(lines, JSONL(), create_schema(col1=t.Int32)), lambda df, number: seen.append([r.col1 for r in df.collect()]), available=True)
    assert seen == [[1, 1], [2, 2]]


def chains():
    """Operations of all kinds."""

    def joined(left, right):
        left["n"] = left["n"] + right["n"]

    def spread(row, factory):
        for k in range(row["col1"] % 3):
            made = factory()
            made["col1"], made["n"] = k, row["col1"]

    one, total = (AddColumn("n", t.Int64), Map({"n": F.lit(1)})), {"n": F.sum("n")}
    pairs = F.transform(F.sequence(F.lit(0), F.col("col1") % 2), lambda i: F.struct(i.alias("col1"), F.lit(1).alias("n")))
    return {
        "none": (),
        "constant key": (*one, Reduce(F.lit(1), total)),
        "columns": (*one, Reduce(key_columns("col1"), total), Repartition(2, key_columns("n"))),
        "expression, function": (*one, Reduce(F.col("col1") % 3, joined), RenameColumn("n", "m")),
        "functions": (*one, Reduce(lambda row: b"%d" % (row["col1"] % 3), joined), RemoveColumn("col1")),
        "columns, function": (*one, Reduce(key_columns("col1"), joined)),
        "flat map": (*one, FlatMap(pairs), Reduce(key_columns("col1"), total)),
        "flat map, function": (*one, FlatMap(spread), Filter(lambda row: row["n"] > 2), RepartitionReduce(2, key_columns("col1"), total)),
        "map, function": (*one, Map(lambda row: row.set("n", row["col1"])), RemoveColumn("col1"), Reduce(F.lit("all"), total)),
    }


@pytest.mark.parametrize("chain", ["none", "constant key", "columns", "expression, function", "functions", "columns, function", "flat map", "flat map, function", "map, function"])
def test_batches_taken_at_once_keep_apart(spark, chain):
    operations, one, two, numbers = chains()[chain], [], [], []

    def source(**several):
        lines = generator_source(spark, [lambda k, g=g: f'{{"col1": {(3 * k + g) % 7}}}' for g in range(3)], 4, 3, **several)
        return stream_pipeline(lines, JSONL(), create_schema(col1=t.Int32)).to(*operations)

    def plain(rows):
        return sorted(repr(sorted(r.asDict().items())) for r in rows)

    def sink(df, number):
        numbers.append(number)
        rows = df.collect()
        for b in range(2 - number):
            two.append(plain(r for r in rows if r[BATCH] == b))
        assert {r[BATCH] for r in rows} <= set(range(2 - number))

    # the key's other column is any one of its rows'
    hide = ("col1",) if any(isinstance(op, Reduce) and not isinstance(op.key, tuple) for op in operations) else ()
    run_stream(source(), lambda df, number: one.append(plain(df.drop(*hide).collect())), available=True)
    run_stream(source(at_once=2), lambda df, number: sink(df.drop(*hide), number), available=True)
    assert numbers == [0, 1]
    assert [[x.replace(f"('{BATCH}', {b}), ", "") for x in rows] for rows, b in zip(two, [0, 1, 0], strict=True)] == one


def test_a_custom_operation_sees_one_batch(spark):
    lines = generator_source(spark, [lambda k: f'{{"col1": {k}}}'], 2, 4, at_once=2)
    p = stream_pipeline(lines, JSONL(), create_schema(col1=t.Int32)).to(Custom(lambda df, schema: (df, schema)))
    with pytest.raises(ValueError, match="one batch at a time"):
        run_stream(p, lambda df, number: None, available=True)


def test_long_batches_are_made_by_several_tasks(spark):
    seen = []
    lines = generator_source(spark, [lambda k: str(k)], 60_000, 2)
    p = stream_pipeline(lines, JSONL(), create_schema(col1=t.Int32))
    run_stream(p, lambda df, number: seen.append((df.rdd.getNumPartitions(), df.count())), available=True)
    assert seen == [(3, 60_000)] * 2


def starts(monkeypatch, at_once):
    """The sizes of what the queries' streams hand to their sinks, as they run."""
    sizes = []

    def counted(pipeline, sink, **rest):
        def also(df, number):
            sink(df, number)
            sizes.append(df.count())

        run_stream(pipeline, also, **rest)

    monkeypatch.setattr(queries, "run_stream", counted)
    if at_once:
        monkeypatch.setattr(queries, "STREAM_AT_ONCE", at_once)
    return sizes


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize(("at_once", "sizes"), [(None, [10]), (4, [4, 4, 2])])
def test_stream_reduce_starts_seldom(spark, monkeypatch, at_once, sizes):
    seen = starts(monkeypatch, at_once)
    got = queries.stream_reduce(spark, DIR)
    assert seen == sizes
    assert sorted(map(tuple, got.select("n", "least", "most").collect())) == [(1000, 1000 * b, 1000 * b + 999) for b in range(10)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize(("at_once", "sizes"), [(None, [2, 8]), (3, [2, 3, 3, 2])])
def test_stream_restart_starts_seldom(spark, monkeypatch, at_once, sizes):
    seen = starts(monkeypatch, at_once)
    got = queries.stream_restart(spark, DIR)
    assert got.columns == ["event_id"]
    assert seen == [1000 * n for n in sizes]
    assert sorted(r.event_id for r in got.collect()) == list(range(10_000))
