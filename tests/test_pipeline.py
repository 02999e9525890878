import time
from collections import Counter as Bag

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow import types as t
from weirflow.errors import RunTimeout, SchemaError
from weirflow.functions import Accumulator, Counter, adder, compose
from weirflow.operators import Accumulate, AddColumn, Collect, Custom, Filter, FlatMap, ForEach, Group, Map, Reduce, RemoveColumn, RenameColumn, Repartition, RepartitionReduce, col, key_columns
from weirflow.plans import Pipeline, RunOptions
from weirflow.schema import create_schema
from weirflow.sources import DSV, JSONL, custom_source, file_source, memory_source


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def numbers(spark, n=10):
    return memory_source(spark, [f'{{"col1": "{i}"}}' for i in range(n)], JSONL(), create_schema(col1=t.Int32))


def words(spark, text="abc", n=10):
    return memory_source(spark, [f'{{"col1": "{text}"}}'] * n, JSONL(), create_schema(col1=t.String(3)))


def test_accumulate(spark):
    assert numbers(spark, 100).to(Accumulate(compose(Counter, adder("col1")))).run().accumulated == [100, 4950.0]


def test_accumulate_in_python_and_empty(spark):
    class Longest(Accumulator):
        def __init__(self):
            self.n = 0

        def accumulate(self, row):
            self.n = max(self.n, row["col1"])

        def merge(self, other):
            self.n = max(self.n, other.n)

        def value(self):
            return self.n

    assert numbers(spark, 20).to(Accumulate(Longest)).run().accumulated == 19
    assert numbers(spark, 20).to(Accumulate(compose(Longest, Counter))).run().accumulated == [19, 20]
    assert numbers(spark, 5).to(Filter(F.lit(False)), Accumulate(adder("col1"))).run().accumulated == 0.0
    with pytest.raises(SchemaError):
        numbers(spark, 5).to(Accumulate(adder("other"))).run()


def test_collect_with_row_function(spark):
    def upper(row):
        row["res"] = row["col1"].upper()

    p = words(spark).to(AddColumn("res", t.VarString), Map(upper), RemoveColumn("col1"), Collect(2))
    got = p.run(RunOptions(partition_size=5)).collected
    assert len(got) == 10 and {r.res for r in got} == {"ABC"} and got[0].__fields__ == ["res"]
    with pytest.raises(SchemaError):
        p.to(Filter(F.lit(True)))


def test_flat_map_tiers_agree(spark):
    def letters(row, new):
        for c in row["col1"]:
            new()["res"] = c.upper()

    base = words(spark).to(AddColumn("res", t.String(1)))
    opaque = base.to(FlatMap(letters)).dataframe()
    seen = base.to(FlatMap(F.split(F.upper("col1"), ""), into="res")).dataframe()
    assert rows(opaque.select("res"), "res") == rows(seen.select("res"), "res") == sorted([("A",), ("B",), ("C",)] * 10)
    assert opaque.where("col1 is not null").count() == 0


def test_row_errors(spark):
    def odd(row):
        if row["col1"] % 2:
            raise ValueError("odd")

    p = numbers(spark).to(Map(odd))
    assert rows(p.dataframe(RunOptions(ignore_row_errors=True)), "col1") == [(0,), (2,), (4,), (6,), (8,)]
    found = p.errors().collect()
    assert len(found) == 5 and all("Map failed on row {col1: " in r.error and "ValueError: odd" in r.error for r in found)
    with pytest.raises(Exception, match="Map failed on row"):
        p.dataframe().collect()


def test_filter_error_drops_the_row(spark):
    def pick(row):
        if row["col1"] == 3:
            raise KeyError("three")
        return row["col1"] < 5

    assert rows(numbers(spark).to(Filter(pick)).dataframe(RunOptions(ignore_row_errors=True)), "col1") == [(0,), (1,), (2,), (4,)]


def test_reduce_and_single_rows(spark):
    called = words(spark, n=100).to(AddColumn("count", t.Uint32), Map({"count": F.lit(1)}))
    assert rows(called.to(Reduce(F.lit("x"), {"count": F.sum("count")})).dataframe(), "col1", "count") == [("abc", 100)]

    def never(left, right):
        raise AssertionError

    assert numbers(spark).to(Reduce(key_columns("col1"), never)).dataframe().count() == 10


def test_shuffle_errors_are_survived(spark):
    def key(row):
        if row["col1"] < 2:
            raise ValueError("small")
        return b"k"

    def add(left, right):
        if left["col1"] + right["col1"] > 15:
            raise ValueError("large")
        left["col1"] = left["col1"] + right["col1"]

    p = numbers(spark).to(Reduce(key, add))
    got = p.dataframe(RunOptions(ignore_row_errors=True)).collect()
    assert len(got) == 1 and got[0].col1 <= 15
    found = [r.error for r in p.errors().collect()]
    keying = [e for e in found if "Keying failed on row" in e and "ValueError: small" in e]
    reducing = [e for e in found if "Reduction failed on row {col1: " in e and "ValueError: large" in e]
    assert len(keying) == 2 and reducing and len(keying) + len(reducing) == len(found)
    with pytest.raises(Exception, match="Keying failed on row|Reduction failed on row"):
        p.dataframe().collect()


def test_reduction_errors_are_listed_for_every_row(spark):
    def fails(left, right):
        raise ValueError("never")

    p = numbers(spark, 12).to(Reduce(F.lit(1), fails))
    assert p.errors().count() == 11
    assert p.dataframe(RunOptions(ignore_row_errors=True)).count() == 1


def test_strict_keys(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (None, 3)], "k int, v int")
    p = Pipeline.of(df).to(Reduce(key_columns("k"), {"v": F.sum("v")}))
    assert rows(p.dataframe().na.fill(-1), "k", "v") == [(-1, 5), (1, 1)]
    with pytest.raises(Exception, match="column k has no value"):
        p.dataframe(RunOptions(strict_keys=True)).collect()


def test_errors_are_logged_at_the_driver(spark, caplog):
    def odd(row):
        if row["col1"] % 2:
            raise ValueError("odd")

    def fails(left, right):
        raise ValueError("never")

    p = numbers(spark, 100).to(Map(odd), Reduce(F.lit(1), fails))
    with caplog.at_level("ERROR", "weirflow"):
        p.run(RunOptions(ignore_row_errors=True, log_errors=1000))
    said = [r.getMessage() for r in caplog.records]
    assert sum("Map failed on row" in m for m in said) == 50 and sum("Reduction failed on row" in m for m in said) == 49
    caplog.clear()
    with caplog.at_level("ERROR", "weirflow"):
        p.run(RunOptions(ignore_row_errors=True, log_errors=7))
    assert len(caplog.records) == 7


def test_statistics_of_stages(spark):
    stats = numbers(spark, 30).to(Reduce(F.col("col1") % 4, {"col1": F.sum("col1")})).run().stats
    names = ("partitions", "stage_seconds", "transform_seconds", "shuffle_seconds", "partition_seconds")
    assert len({len(stats[n]) for n in names}) == 1 and len(stats["partitions"]) >= 2
    assert all(n >= 1 for n in stats["partitions"]) and all(x >= 0 for n in names for x in stats[n]) and sum(stats["transform_seconds"]) > 0


def test_custom_parser_and_source(spark):
    class Pairs:
        """Lines with an equals sign."""

        def read_buffers(self, buffers, schema):
            lines = buffers.select(F.explode(F.split(F.decode("buffer", "UTF-8"), "\n")).alias("line"))
            cells = F.split("line", "=")
            return lines.select(*(F.get(cells, i).cast(k.spark).alias(n) for i, (n, k) in enumerate(schema)))

        def read_files(self, spark, paths, schema):
            return self.read_buffers(spark.read.format("binaryFile").load(paths).select(F.col("content").alias("buffer")), schema)

    class Squares:
        """As many buffers as it is told, each made where it is needed."""

        def __init__(self, n):
            self.n = n

        def read(self, spark, parser, schema):
            made = spark.range(self.n).select(F.encode(F.concat_ws("=", F.col("id"), F.col("id") * F.col("id")), "UTF-8").alias("buffer"))
            return parser.read_buffers(made, schema)

    schema = create_schema(k=t.VarString, v=t.Int32)
    assert rows(memory_source(spark, ["a=1\nb=2", "c=3"], Pairs(), schema).dataframe(), "k", "v") == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(custom_source(spark, Squares(3), schema, Pairs()).to(Filter(F.col("v") > 0)).dataframe(), "k", "v") == [("1", 1), ("2", 4)]
    with pytest.raises(SchemaError):
        custom_source(spark, Squares(3), create_schema(k=t.VarString), type("Other", (Pairs,), {"read_buffers": lambda self, b, s: b})())


def test_error_shows_the_row_as_it_was(spark):
    def change(row):
        row["col1"] = row["col1"] + 100
        raise ValueError("after the change")

    assert "{col1: 0}" in numbers(spark, 1).to(Map(change)).errors().first().error


def test_rows_of_each_stage_are_counted(spark):
    p = numbers(spark, 30).to(Filter(F.col("col1") < 20), Reduce(F.col("col1") % 4, {"col1": F.sum("col1")}), Filter(F.col("col1") > 46))
    assert p.to(Collect(4)).run(RunOptions(count_rows=True)).stats["rows"] == [4, 2]
    assert p.to(Accumulate(Counter)).run(RunOptions(count_rows=True)).stats["rows"] == [4, 2]
    assert p.run(RunOptions(count_rows=True)).stats["rows"] == [4, 2]
    assert "rows" not in p.run().stats


def test_run_stops_at_its_time_limit(spark):
    def sleeps(row):
        import time

        time.sleep(30)

    began = time.time()
    with pytest.raises(RunTimeout):
        numbers(spark, 1).to(Map(sleeps)).run(RunOptions(timeout=2))
    assert time.time() - began < 20
    assert numbers(spark).to(Accumulate(Counter)).run(RunOptions(timeout=60)).accumulated == 10


def test_group_and_repartition(spark):
    lines = "\n".join(f'{{"col1": "{x}"}}' for x in ["abc", "def"] * 5)
    p = memory_source(spark, [lines, lines], JSONL(), create_schema(col1=t.String(3)))
    grouped = p.to(Group(key_columns("col1"))).dataframe()
    where = grouped.select("col1", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(where) == 2 and grouped.count() == 20
    got = p.to(Repartition(10, key_columns("col1")), Collect(4)).run()
    assert sorted(len(c) for c in got.chunks) == [10, 10] and all(len({r.col1 for r in c}) == 1 for c in got.chunks)
    assert len(got.collected) == 20 and got.collected[0].__fields__ == ["col1"]
    assert len(p.to(Repartition(4, key_columns("col1")), Collect(3)).run().chunks) == 3
    sizes = p.to(Repartition(4, key_columns("col1"))).chunked().groupBy("col1", "chunk").count()
    assert rows(sizes, "col1", "count") == [("abc", 2), ("abc", 4), ("abc", 4), ("def", 2), ("def", 4), ("def", 4)]
    with pytest.raises(SchemaError):
        p.to(Group(key_columns("col1"))).chunked()


def test_chunks_of_common_keys_and_of_reductions(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, id % 7, null) as k", "id as v").union(spark.range(50).selectExpr("null as k", "cast(5 as long) as v"))
    base = Pipeline.of(df)
    sized = base.to(Repartition(10, key_columns("k"))).chunked()
    for r in sized.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk").alias("chunks")).collect():
        assert r.chunks == -(-r.n // 10)
    assert sized.groupBy("chunk").agg(F.countDistinct(F.coalesce("k", F.lit(-1))).alias("keys"), F.count(F.lit(1)).alias("n")).where("keys > 1 or n > 10").count() == 0
    assert sorted((r.k is None, r.k or 0, r.v) for r in sized.collect()) == sorted((r.k is None, r.k or 0, r.v) for r in df.collect())
    key = lambda row: b"%d" % (row["v"] % 35)

    def add(left, right):
        left["v"] = left["v"] + right["v"]

    for reduced in (base.to(RepartitionReduce(8, F.col("v") % 35, {"v": F.sum("v")})), base.to(RepartitionReduce(8, key, add))):
        sizes = [r["count"] for r in reduced.chunked().groupBy("chunk").count().collect()]
        assert sorted(sizes) == [3, 8, 8, 8, 8] and reduced.dataframe().columns == ["k", "v"]
        assert sum(r.v for r in reduced.dataframe().collect()) == 999 * 500 + 250
        assert [len(c) for c in reduced.to(Collect(2)).run().chunks] in ([8, 8], [8, 3], [3, 8])
    after = base.to(Repartition(10, key_columns("k")), Filter(F.col("v") < 5)).dataframe()
    assert after.columns == ["k", "v"] and after.count() == 5


def test_columns_are_visible_by_stage(spark):
    p = numbers(spark, 3).to(AddColumn("two", t.Int64), RemoveColumn("col1"), Map({"two": col("col1") * 2}))
    assert rows(p.dataframe(), "two") == [(0,), (2,), (4,)]
    for bad in (RenameColumn("nope", "x"), RemoveColumn("nope"), AddColumn("col1", t.Int8), Map({"nope": F.lit(1)}), Group(key_columns("nope"))):
        with pytest.raises(SchemaError):
            numbers(spark, 3).to(bad)
    with pytest.raises(SchemaError):
        numbers(spark, 3).to(AddColumn("b", t.Int8), Group(key_columns("col1")), RemoveColumn("col1"), RemoveColumn("col1"))
    renamed = numbers(spark, 3).to(RenameColumn("col1", "n"), Map({"n": col("n") + 1})).dataframe()
    assert rows(renamed, "n") == [(1,), (2,), (3,)]


def test_custom_operation_foreach_and_codec(spark, tmp_path):
    def double(df, schema):
        return df.union(df), schema

    assert numbers(spark, 4).to(Custom(double)).dataframe().count() == 8
    place = str(tmp_path)

    def note(row):
        open(f"{place}/{row['col1']}", "w").close()

    numbers(spark, 4).to(ForEach(note)).run()
    assert {p.name for p in tmp_path.iterdir()} == {"0", "1", "2", "3"}
    pairs = t.coded("pairs", lambda v: repr(v).encode(), lambda b: eval(b.decode()))

    def make(row):
        row["p"] = {row["col1"]: 1}

    def merge(left, right):
        left["p"] = {**left["p"], **right["p"]}

    got = numbers(spark, 4).to(AddColumn("p", pairs), Map(make), Reduce(F.lit(1), merge)).dataframe().collect()
    assert eval(bytes(got[0].p).decode()) == {0: 1, 1: 1, 2: 1, 3: 1}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-100, 100)), min_size=1, max_size=40), st.integers(1, 5))
def test_reduce_does_not_depend_on_partitions(spark, data, parts):
    df = spark.createDataFrame(data, "k long, v long").repartition(parts)

    def add(left, right):
        left["v"] = left["v"] + right["v"]

    want = Bag()
    for k, v in data:
        want[k] += v
    want = sorted((k, want[k]) for k in {k for k, _ in data})
    p = Pipeline.of(df)
    assert rows(p.to(Reduce(key_columns("k"), add)).dataframe(), "k", "v") == want
    assert rows(p.to(Reduce(key_columns("k"), {"v": F.sum("v")})).dataframe(), "k", "v") == want
    assert rows(p.to(Group(key_columns("k"))).dataframe(), "k", "v") == sorted(data)


def test_explain_shows_partial_aggregation_and_pruning(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 as k", "id as v", "id as unused").write.parquet(str(tmp_path / "t"))
    p = Pipeline.of(spark.read.parquet(str(tmp_path / "t"))).to(Filter(F.col("v") > 5), RemoveColumn("unused"), Reduce(key_columns("k"), {"v": F.sum("v")}))
    plan = p.dataframe()._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "PushedFilters: [IsNotNull(v), GreaterThan(v,5)]" in plan and "ReadSchema: struct<k:bigint,v:bigint>" in plan


def test_dsv_cells(spark):
    schema = create_schema(a=t.Int8, b=t.Uint8, c=t.Bool, d=t.Float32, e=t.String(3), f=t.Time("2006-01-02 15:04:05"), g=t.Bytes(2), h=t.VarString)
    text = '# note\nhead,x,x,x,x,x,x,x\n-5,255,T,1.5,abcd,2020-01-02 03:04:05,ab,"say ""hi"",\nnew line"\n,,,,,,,\nnull,null,null,null,null,null,null,null\n'
    got = memory_source(spark, [text], DSV(header_lines=1, comment="#", nil_value="null"), schema).dataframe().collect()
    assert (got[0].a, got[0].b, got[0].c, got[0].d, got[0].e, str(got[0].f), bytes(got[0].g), got[0].h) == (-5, 255, True, 1.5, "abc", "2020-01-02 03:04:05", b"ab", 'say "hi",\nnew line')
    assert all(v is None for r in got[1:] for v in r) and len(got) == 3
    for bad in ("1,2", "300,1,T,1,a,2020-01-02 03:04:05,ab,x", "1,-1,T,1,a,2020-01-02 03:04:05,ab,x", "1,1,yes,1,a,2020-01-02 03:04:05,ab,x", "1,1,T,1,a,soon,ab,x", "1,1,T,1,a,2020-01-02 03:04:05,abc,x", "1,1,T,z,a,2020-01-02 03:04:05,ab,x"):
        with pytest.raises(Exception):
            memory_source(spark, [bad], DSV(), schema).dataframe().collect()


def test_dsv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;w\n1;"x ""y"""\n2;"two\nlines"\n')
    (tmp_path / "b.csv").write_text("n;w\n3;null\n")
    schema = create_schema(n=t.Int32, w=t.VarString)
    p = DSV(header_lines=1, delimiter=";", nil_value="null", multiline=True)
    assert sorted(map(tuple, file_source(spark, f"{tmp_path}/*.csv", p, schema).dataframe().collect())) == [(1, 'x "y"'), (2, "two\nlines"), (3, None)]
    assert file_source(spark, f"{tmp_path}/*.csv", DSV(header_lines=2, delimiter=";", multiline=True), schema).dataframe().count() == 1
    with pytest.raises(Exception, match="quote is open at the end of a line"):
        file_source(spark, f"{tmp_path}/a.csv", DSV(header_lines=1, delimiter=";"), schema).dataframe().collect()
    assert rows(file_source(spark, f"{tmp_path}/b.csv", DSV(header_lines=1, delimiter=";", nil_value="null"), schema).dataframe(), "n", "w") == [(3, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        file_source(spark, f"{tmp_path}/*.none", DSV(), schema)
    got = file_source(spark, f"{tmp_path}/a.csv", DSV(header_lines=1, delimiter=";"), schema, decoder=lambda b: b.upper())
    assert rows(got.dataframe(), "w") == [("TWO\nLINES",), ('X "Y"',)]


def test_jsonl_coercions(spark):
    schema = create_schema(**{"meta.index": t.Int8, "meta.first": t.VarString, "f": t.Float64, "b": t.Bool, "when": t.Time("2006-01-02 15:04:05")})
    lines = ['{"meta": {"index": 300, "first": "Zoë", "x": 1}, "f": "2.5", "b": 2, "when": "2020-01-02 03:04:05"}', '{"meta": {"index": "7", "first": {"a": 1}}, "b": "false", "f": null}', "", "not json"]
    got = memory_source(spark, ["\n".join(lines)], JSONL(), schema).dataframe().collect()
    assert [r["meta.index"] for r in got] == [44, 7, None, None]
    assert [r["meta.first"] for r in got] == ["Zoë", '{"a":1}', None, None]
    assert [r["f"] for r in got] == [2.5, None, None, None] and [r["b"] for r in got] == [True, False, None, None]
    assert str(got[0]["when"]) == "2020-01-02 03:04:05"
    skipped = memory_source(spark, ['head\n// note\n{"f": 1}\n'], JSONL(header_lines=1, comment="//"), create_schema(f=t.Float64)).dataframe()
    assert rows(skipped, "f") == [(1.0,)]
    zero = memory_source(spark, ["{}"], JSONL(nil_as_zero=True), create_schema(f=t.Float64, s=t.VarString)).dataframe()
    assert tuple(zero.first()) == (0.0, None)
    with pytest.raises(SchemaError):
        memory_source(spark, ["{}"], JSONL(), create_schema(f=t.Uint8))
    with pytest.raises(Exception, match="longer than"):
        memory_source(spark, ['{"f": 1}'], JSONL(max_line=4), create_schema(f=t.Float64)).dataframe().collect()


def test_large_files_are_split(spark, tmp_path):
    lines = [f'{i};"say ""{i}"";"' for i in range(60_000)]
    (tmp_path / "a.csv").write_text("head;x\r\nmore;y\r\n" + "\r\n".join(lines) + "\r\n")
    (tmp_path / "b.csv").write_text("head;x\nmore;y\n# note\n\n7;seven\n")
    (tmp_path / "c.jsonl").write_text("head\n" + "\n".join(f'{{"n": {i}}}' for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        schema = create_schema(n=t.Int32, w=t.VarString)
        df = file_source(spark, f"{tmp_path}/*.csv", DSV(header_lines=2, delimiter=";", comment="#"), schema).dataframe()
        assert df.rdd.getNumPartitions() >= 4
        got = sorted(map(tuple, df.collect()))
        assert got == sorted([(i, f'say "{i}";') for i in range(60_000)] + [(7, "seven")])
        df = file_source(spark, f"{tmp_path}/c.jsonl", JSONL(header_lines=1), create_schema(n=t.Int32)).dataframe()
        assert df.rdd.getNumPartitions() >= 3 and df.agg(F.sum("n")).first()[0] == 60_000 * 59_999 // 2 and df.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for bad in ("1;2;3", "1"):
        (tmp_path / "d.csv").write_text(bad)
        with pytest.raises(Exception):
            file_source(spark, f"{tmp_path}/d.csv", DSV(delimiter=";"), schema).dataframe().collect()


def test_widths_are_bytes(spark):
    text = "éééé|aé日|日日|abc|é日|\U0001f642x"
    want = ["é", "aé", "日", "abc", "é", ""]
    parsed = memory_source(spark, ["\n".join(text.split("|"))], DSV(), create_schema(w=t.String(3))).dataframe()
    assert [r.w for r in parsed.collect()] == want
    lines = [f'{{"w": "{x}"}}' for x in text.split("|")]
    parsed = memory_source(spark, ["\n".join(lines)], JSONL(), create_schema(w=t.String(3)))
    assert [r.w for r in parsed.dataframe().collect()] == want

    def same(row):
        row["w"] = row["w"]

    assert parsed.to(Map(same)).dataframe().count() == 6
