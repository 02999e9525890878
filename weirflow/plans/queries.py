"""The driver's queries, one per operator, with their SQL."""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StreamTimeout
from ..functions import Accumulator, Counter, adder, compose
from ..operators import Accumulate, AddColumn, Collect, Custom, Filter, FlatMap, ForEach, Group, Map, Reduce, RemoveColumn, RenameColumn, Repartition, RepartitionReduce, col, key_columns
from ..schema import create_schema
from ..shipping import shared_root
from ..sources import DSV, JSONL, custom_source, file_source, memory_source, table_source
from ..streaming import BATCH, generator_source, run_stream, stream_pipeline
from ..types import Float64, Int32, Int64, String, VarString, custom
from . import Pipeline, RunOptions

STREAM_BATCH = 1000
#: Batches of a stream that Spark takes at once; each is reduced on its own.
STREAM_AT_ONCE = 250


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Pipeline:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table_source(df.select(*columns) if columns else df)


def cents(name: str):
    return F.round(col(name) * 100).cast("long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: how many, and the sum of their values in cents."""
    hour = F.date_format("ts", "yyyy-MM-dd HH")
    p = read(spark, sf_dir, "events", "ts", "event_type", "value").to(AddColumn("hour", VarString), AddColumn("n", Int64), AddColumn("cents", Int64))
    p = p.to(Map({"hour": hour, "n": F.lit(1), "cents": cents("value")}), RemoveColumn("ts", "value"), Reduce(key_columns("hour", "event_type"), {"n": F.sum("n"), "cents": F.sum("cents")}))
    return p.dataframe()


def add_column(spark, sf_dir):
    return read(spark, sf_dir, "orders").to(AddColumn("note", VarString)).dataframe()


def remove_column(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").to(RemoveColumn("l_tax", "l_discount", "l_shipdate", "l_linestatus")).dataframe()


def rename_column(spark, sf_dir):
    return read(spark, sf_dir, "customer").to(RenameColumn("c_name", "customer_name")).dataframe()


def map_expr(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_discount")
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)
    p = p.to(AddColumn("flag", VarString), AddColumn("net", Int64), Map({"flag": F.lower("l_returnflag"), "net": net}))
    p = p.to(RemoveColumn("l_extendedprice", "l_discount", "l_returnflag"))
    return p.dataframe()


def map_after_remove(spark, sf_dir):
    """A removed column is read by a later operation of its stage."""
    p = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_tax").to(RemoveColumn("l_tax"), AddColumn("tax_percent", Int64), Map({"tax_percent": cents("l_tax")}))
    return p.dataframe()


def filter_expr(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    return p.to(Filter((F.col("l_discount") >= 0.05) & (F.col("l_returnflag") == "R"))).dataframe()


def flat_map(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_name").to(AddColumn("word", VarString), FlatMap(F.split("p_name", " "), into="word", keep=("p_partkey",)), RemoveColumn("p_name"))
    return p.dataframe()


def flat_map_filter(spark, sf_dir):
    """As many first letters of the name as the size's last digit says: none for some rows."""
    letters = F.transform(F.sequence(F.lit(0), F.pmod("p_size", F.lit(5))), lambda i: F.when(i > 0, F.substring(F.col("p_name"), i, F.lit(1))))
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").to(AddColumn("letter", VarString), FlatMap(F.filter(letters, lambda x: x.isNotNull()), into="letter", keep=("p_partkey",)))
    return p.to(RemoveColumn("p_name", "p_size")).dataframe()


def reduce_count(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem", "l_orderkey").to(AddColumn("count", Int64), Map({"count": F.lit(1)}), RemoveColumn("l_orderkey"), Reduce(F.lit(1), {"count": F.sum("count")}))
    return p.dataframe()


def _flags(spark, sf_dir) -> Pipeline:
    p = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", "l_linenumber")
    p = p.to(AddColumn("n", Int64), AddColumn("cents", Int64), AddColumn("least", Int64), AddColumn("most", Int64))
    p = p.to(Map({"n": F.lit(1), "cents": cents("l_extendedprice"), "least": cents("l_extendedprice"), "most": cents("l_extendedprice")}))
    return p.to(RemoveColumn("l_extendedprice", "l_linenumber"))


def reduce_key_columns(spark, sf_dir):
    merge = {"n": F.sum("n"), "cents": F.sum("cents"), "least": F.min("least"), "most": F.max("most")}
    return _flags(spark, sf_dir).to(Reduce(key_columns("l_returnflag", "l_linestatus"), merge)).dataframe()


def reduce_opaque(spark, sf_dir):
    """The same result from a Python function, folded within tasks before the shuffle."""

    def merge(left, right):
        left["n"] = left["n"] + right["n"]
        left["cents"] = left["cents"] + right["cents"]
        left["least"] = min(left["least"], right["least"])
        left["most"] = max(left["most"], right["most"])

    return _flags(spark, sf_dir).to(Reduce(key_columns("l_returnflag", "l_linestatus"), merge)).dataframe()


def reduce_key_expr(spark, sf_dir):
    return flagship(spark, sf_dir)


def reduce_distinct(spark, sf_dir):
    return read(spark, sf_dir, "events", "user_id", "event_type").to(Reduce(key_columns("user_id", "event_type"), {})).dataframe()


def group(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").to(Group(key_columns("l_orderkey"))).dataframe()


def repartition(spark, sf_dir):
    """Rows of a supplier in chunks of ten: how many chunks, and how many rows in the last."""
    p = read(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber").to(Repartition(10, key_columns("l_suppkey")))
    sizes = p.chunked().groupBy("l_suppkey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("largest"), F.max_by("n", "chunk").alias("last"))


def repartition_reduce(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").to(AddColumn("cents", Int64), Map({"cents": cents("l_quantity")}), RemoveColumn("l_quantity"))
    return p.to(RepartitionReduce(10, key_columns("l_suppkey"), {"cents": F.sum("cents")})).dataframe()


def two_stage(spark, sf_dir):
    """Orders per customer, then customers per number of orders."""
    p = read(spark, sf_dir, "orders", "o_custkey").to(AddColumn("orders", Int64), Map({"orders": F.lit(1)}), Reduce(key_columns("o_custkey"), {"orders": F.sum("orders")}))
    p = p.to(AddColumn("customers", Int64), Map({"customers": F.lit(1)}), RemoveColumn("o_custkey"), Reduce(key_columns("orders"), {"customers": F.sum("customers")}))
    return p.dataframe()


def collect_all(spark, sf_dir):
    p = read(spark, sf_dir, "nation").to(Collect(100))
    return spark.createDataFrame(p.run(RunOptions(partition_size=128)).collected, p.source.schema)


def acc_count(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").to(Accumulate(Counter)).run().accumulated
    return spark.createDataFrame([(n,)], "n long")


def acc_sum(spark, sf_dir):
    total = read(spark, sf_dir, "lineitem").to(Accumulate(adder("l_linenumber"))).run().accumulated
    return spark.createDataFrame([(total,)], "total double")


def acc_compose(spark, sf_dir):
    values = read(spark, sf_dir, "lineitem").to(Accumulate(compose(Counter, adder("l_linenumber")))).run().accumulated
    return spark.createDataFrame([tuple(values)], "n long, total double")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/weirflow-{name}-{uuid.uuid4().hex}"


ORDER_SCHEMA = create_schema(o_orderkey=Int64, o_custkey=Int64, o_orderstatus=VarString, o_totalprice=Float64, o_orderpriority=VarString)


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*ORDER_SCHEMA.columns)


def parse_dsv(spark, sf_dir):
    """Orders written as lines with bars, and parsed back."""
    path = _scratch(spark, "dsv")
    _orders(spark, sf_dir).write.csv(path, sep="|", quote='"', escape='"')
    return file_source(spark, path, DSV(delimiter="|"), ORDER_SCHEMA).dataframe()


def parse_dsv_nil(spark, sf_dir):
    path = _scratch(spark, "dsv-nil")
    marked = _orders(spark, sf_dir).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "null").otherwise(F.col("o_orderstatus")))
    marked.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, "null").otherwise(F.col("o_custkey").cast("string"))).write.csv(path, sep="|", quote='"', escape='"')
    return file_source(spark, path, DSV(delimiter="|", nil_value="null"), ORDER_SCHEMA).dataframe()


def parse_jsonl(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("props").alias("value"))
    out = JSONL().parse(lines, create_schema(k=Int32))
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def parse_jsonl_paths(spark, sf_dir):
    """Nested values by dotted names, which stay flat columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.select(F.to_json(F.struct("event_id", F.struct("user_id", "event_type").alias("meta"))).alias("value"))
    schema = create_schema(event_id=Int64, **{"meta.user_id": Int64, "meta.event_type": VarString})
    return JSONL().parse(lines, schema).withColumnsRenamed({"meta.user_id": "user_id", "meta.event_type": "event_type"})


def file_decoder(spark, sf_dir):
    """Files that a Python function decodes before they are parsed."""
    path = _scratch(spark, "decoded")
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    rows.select(F.to_json(F.struct("*"))).write.text(path, compression="deflate")
    return file_source(spark, f"{path}/*.deflate", JSONL(), create_schema(o_orderkey=Int64, o_custkey=Int64), decoder=zlib.decompress).dataframe()


Heatmap = custom("heatmap", T.MapType(T.IntegerType(), T.LongType()))


def heatmap_custom_type(spark, sf_dir):
    """Events by hour, each hour a map of cell to count; given out as rows."""
    cell = F.pmod("user_id", F.lit(16)).cast("int")
    hour = F.date_format("ts", "yyyy-MM-dd HH")
    p = read(spark, sf_dir, "events", "ts", "user_id").to(AddColumn("hour", VarString), AddColumn("cell", Int32), AddColumn("n", Int64), AddColumn("heatmap", Heatmap))
    p = p.to(Map({"hour": hour, "cell": cell, "n": F.lit(1)}), RemoveColumn("ts", "user_id"), Reduce(key_columns("hour", "cell"), {"n": F.sum("n")}))
    p = p.to(Reduce(key_columns("hour"), {"heatmap": F.map_from_entries(F.collect_list(F.struct("cell", "n")))}), RemoveColumn("cell", "n"))
    return p.dataframe().select("hour", F.explode("heatmap").alias("cell", "n"))


def row_error_skip(spark, sf_dir):
    """A row function that fails on odd keys; the rows are left out."""

    def fails(row):
        if row["o_orderkey"] % 2:
            raise ValueError("odd")

    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").to(Map(fails)).dataframe(RunOptions(ignore_row_errors=True))


def shuffle_error_skip(spark, sf_dir):
    """A key function that fails on small keys; the others are counted."""

    def key(row):
        if row["o_custkey"] < 100:
            raise ValueError("small")
        return b"%d" % (row["o_custkey"] % 10)

    def merge(left, right):
        left["n"] = left["n"] + right["n"]

    p = read(spark, sf_dir, "orders", "o_custkey").to(AddColumn("n", Int64), AddColumn("digit", Int64), Map({"n": F.lit(1), "digit": F.col("o_custkey") % 10}), Reduce(key, merge), RemoveColumn("o_custkey"))
    return p.dataframe(RunOptions(ignore_row_errors=True))


def custom_operation(spark, sf_dir):
    """An operation of the user's: a frame and schema to a frame and schema."""

    def brand_digits(df, schema):
        out = schema.clone()
        out.create_column("digits", VarString)
        return df.withColumn("digits", F.regexp_extract("p_brand", "[0-9]+", 0)), out

    return read(spark, sf_dir, "part", "p_partkey", "p_brand").to(Custom(brand_digits)).dataframe()


def stream_reduce(spark, sf_dir):
    """Event ids from four generators, reduced within each batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    count, size = events.count(), STREAM_BATCH // 4

    def generator(g: int) -> Callable[[int], str]:
        def record(k: int) -> str:
            event = k // size * STREAM_BATCH + g * size + k % size
            return f'{{"event_id": {event}}}' if event < count else "{}"

        return record

    lines = generator_source(spark, [generator(g) for g in range(4)], size, limit=-(-count // STREAM_BATCH), at_once=STREAM_AT_ONCE)
    p = stream_pipeline(lines, JSONL(), create_schema(event_id=Int64))
    p = p.to(Filter(F.col("event_id").isNotNull()), AddColumn("n", Int64), AddColumn("least", Int64), AddColumn("most", Int64))
    p = p.to(Map({"n": F.lit(1), "least": F.col("event_id"), "most": F.col("event_id")}), RemoveColumn("event_id"), Reduce(F.lit(1), {"n": F.sum("n"), "least": F.min("least"), "most": F.max("most")}))
    path = _scratch(spark, "stream")
    run_stream(p, lambda df, number: df.drop(BATCH).coalesce(1).write.mode("append").parquet(path), available=True)
    return spark.read.parquet(path)


def group_partitions(spark, sf_dir):
    """In how many partitions the rows of an order stand after grouping."""
    placed = group(spark, sf_dir).select("l_orderkey", F.spark_partition_id().alias("part"))
    return placed.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("partitions"))


def repartition_reduce_sizes(spark, sf_dir):
    """Sizes of the chunks of ten into which the reduced rows are dealt."""
    p = read(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").to(RepartitionReduce(10, key_columns("l_partkey"), {"l_quantity": F.sum("l_quantity")}))
    sizes = p.chunked().groupBy("chunk").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("chunks"))


def collect_chunks(spark, sf_dir):
    """Collected chunks of two nations of a region: region, number of rows, number of regions in the chunk."""
    p = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").to(Repartition(2, key_columns("n_regionkey")), Collect(100))
    found = [(c[0].n_regionkey, len(c), len({r.n_regionkey for r in c})) for c in p.run().chunks]
    return spark.createDataFrame(found, "n_regionkey int, n int, regions int")


def map_opaque(spark, sf_dir):
    """A row function with typed getters and setters."""

    def net(row):
        row.set_var_string("flag", row.get_var_string("l_returnflag").lower())
        row.set_int64("eighths", row.get_int32("l_linenumber") * 8)

    p = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").to(AddColumn("flag", VarString), AddColumn("eighths", Int64), Map(net))
    return p.to(RemoveColumn("l_returnflag")).dataframe()


def flat_map_opaque(spark, sf_dir):
    """The words of a name from a row function and its factory of rows."""

    def words(row, new):
        for w in row["p_name"].split(" "):
            made = new()
            made["p_partkey"], made["word"] = row["p_partkey"], w

    return read(spark, sf_dir, "part", "p_partkey", "p_name").to(AddColumn("word", VarString), FlatMap(words), RemoveColumn("p_name")).dataframe()


def filter_opaque(spark, sf_dir):
    def wanted(row):
        return row["l_returnflag"] == "R" and row["l_linenumber"] > 3

    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").to(Filter(wanted)).dataframe()


def for_each(spark, sf_dir):
    """The effect of a function that is run on every row: it adds to counters of Spark's."""
    seen, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def note(row):
        seen.add(1)
        total.add(row["l_linenumber"])

    read(spark, sf_dir, "lineitem", "l_linenumber").to(ForEach(note)).run()
    return spark.createDataFrame([(seen.value, total.value)], "n long, total long")


def no_terminal(spark, sf_dir):
    """A pipeline without an end runs all the same; its statistics tell the rows of its stages."""
    p = read(spark, sf_dir, "orders", "o_custkey").to(Reduce(key_columns("o_custkey"), {}), Filter(F.col("o_custkey") > 50))
    stats = p.run(RunOptions(count_rows=True)).stats
    return spark.createDataFrame([(n, stats["rows"][n], bool(stats["partitions"])) for n in range(2)], "stage int, n long, timed boolean")


class Longest(Accumulator):
    """An accumulator in Python: the longest text of a column, the first of equals by text."""

    def __init__(self) -> None:
        self.best = ""

    def accumulate(self, row) -> None:
        self._take(row["p_name"])

    def merge(self, other: Longest) -> None:
        self._take(other.best)

    def _take(self, text: str) -> None:
        if (-len(text), text) < (-len(self.best), self.best):
            self.best = text

    def value(self) -> str:
        return self.best


def custom_accumulator(spark, sf_dir):
    return spark.createDataFrame([(read(spark, sf_dir, "part", "p_name").to(Accumulate(Longest)).run().accumulated,)], "longest string")


def memory_buffers(spark, sf_dir):
    """Buffers of the driver: a region's nations in each."""
    held: dict[int, list[str]] = {}
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():
        held.setdefault(r.n_regionkey, []).append(f'{{"key": "{r.n_nationkey}", "name": "{r.n_name}"}}')
    return memory_source(spark, ["\n".join(lines) for lines in held.values()], JSONL(), create_schema(key=Int32, name=VarString)).dataframe()


class Pairs:
    """A parser of lines of fields with their names: name=value, parted by bars."""

    def read_buffers(self, buffers: DataFrame, schema) -> DataFrame:
        lines = buffers.select(F.explode(F.split(F.decode("buffer", "UTF-8"), "\n")).alias("line")).where("line <> ''")
        return self._fields(lines, schema)

    def read_files(self, spark, paths, schema) -> DataFrame:
        return self._fields(spark.read.text(paths).withColumnRenamed("value", "line"), schema)

    def _fields(self, lines: DataFrame, schema) -> DataFrame:
        found = F.str_to_map("line", F.lit("\\|"), F.lit("="))
        return lines.select(*(found[n].cast(k.spark).alias(n) for n, k in schema))


def custom_parser(spark, sf_dir):
    """Files that a parser of the user's reads."""
    path = _scratch(spark, "pairs")
    _orders(spark, sf_dir).select(F.concat(F.lit("o_custkey="), F.col("o_custkey"), F.lit("|o_orderkey="), F.col("o_orderkey"))).write.text(path)
    return file_source(spark, path, Pairs(), create_schema(o_orderkey=Int64, o_custkey=Int64)).dataframe()


class Tabled:
    """A source of the user's: a column of a table as buffers, which a parser reads."""

    def __init__(self, path: str, column: str):
        self.path, self.column = path, column

    def read(self, spark, parser, schema) -> DataFrame:
        return parser.read_buffers(spark.read.parquet(self.path).select(F.encode(self.column, "UTF-8").alias("buffer")), schema)


def custom_source_query(spark, sf_dir):
    p = custom_source(spark, Tabled(f"{sf_dir}/events.parquet", "props"), create_schema(k=Int32), JSONL())
    return p.to(AddColumn("n", Int64), Map({"n": F.lit(1)}), Reduce(key_columns("k"), {"n": F.sum("n")})).dataframe()


def listed_errors(spark, sf_dir):
    """The errors of rows that were left out, by phase and cause."""

    def fails(row):
        if row["o_orderkey"] % 2:
            raise ValueError("odd")

    def never(left, right):
        raise ValueError("never")

    found = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").to(Map(fails), Reduce(key_columns("o_orderstatus"), never)).errors()
    cause = F.regexp_extract("error", "^([A-Za-z]+) failed on row .*: (ValueError: [a-z]+)$", 1).alias("phase"), F.regexp_extract("error", "(ValueError: [a-z]+)$", 1).alias("cause")
    return found.groupBy(*cause).agg(F.count(F.lit(1)).alias("n"))


def parse_header_lines(spark, sf_dir):
    """Two lines before the records of each file, in files that Spark splits."""
    path = _scratch(spark, "headed")
    value = F.concat_ws("|", "o_orderkey", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')))
    files = _orders(spark, sf_dir).groupBy(F.pmod("o_orderkey", F.lit(3)).alias("file")).agg(F.array_join(F.collect_list(value), "\n").alias("lines"))
    made = files.select(F.concat(F.lit("order|priority\nnumber|text\n"), F.col("lines")).alias("value"))
    made.select("value").repartition(3).write.text(path, lineSep="\n")
    return file_source(spark, path, DSV(header_lines=2, delimiter="|"), create_schema(o_orderkey=Int64, o_orderpriority=VarString)).dataframe()


def parse_width(spark, sf_dir):
    """Texts of a width in bytes, cut between characters."""
    path = _scratch(spark, "width")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.to_json(F.struct("doc_id", F.substring("text", 1, 200).alias("text")))).write.text(path)
    p = file_source(spark, path, JSONL(), create_schema(doc_id=Int64, text=String(20)))
    return p.dataframe().select("doc_id", F.octet_length("text").alias("n_bytes"), F.length("text").alias("n_chars"))


def stream_timeout(spark, sf_dir):
    """A stream without an end stops at its time limit, and with it what is available."""
    count = spark.read.parquet(f"{sf_dir}/region.parquet").count()
    stopped = []
    for available in (False, True):
        lines = generator_source(spark, [lambda k: f'{{"n": {k}}}'] * count, 2)
        try:
            run_stream(stream_pipeline(lines, JSONL(), create_schema(n=Int64)), lambda df, number: time.sleep(0.2), timeout=2, available=available)
        except StreamTimeout:
            stopped.append((available, count))
    return spark.createDataFrame(stopped, "available boolean, n long")


def stream_restart(spark, sf_dir):
    """A stream that is stopped and started again gives every record once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    count, size = events.count(), STREAM_BATCH // 4
    checkpoint, path = _scratch(spark, "stopped"), _scratch(spark, "restarted")
    record = lambda g: lambda k: f'{{"event_id": {4 * k + g}}}' if 4 * k + g < count else "{}"
    for batches in (2, -(-count // STREAM_BATCH)):
        lines = generator_source(spark, [record(g) for g in range(4)], size, limit=batches, checkpoint=checkpoint, at_once=STREAM_AT_ONCE)
        p = stream_pipeline(lines, JSONL(), create_schema(event_id=Int64)).to(Filter(F.col("event_id").isNotNull()))
        run_stream(p, lambda df, number: df.drop(BATCH).write.mode("append").parquet(path), available=True, checkpoint=checkpoint)
    return spark.read.parquet(path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "add_column": add_column,
    "remove_column": remove_column,
    "rename_column": rename_column,
    "map_expr": map_expr,
    "map_after_remove": map_after_remove,
    "filter": filter_expr,
    "flat_map": flat_map,
    "flat_map_filter": flat_map_filter,
    "reduce_count": reduce_count,
    "reduce_key_columns": reduce_key_columns,
    "reduce_key_expr": reduce_key_expr,
    "reduce_distinct": reduce_distinct,
    "reduce_opaque": reduce_opaque,
    "group": group,
    "repartition": repartition,
    "repartition_reduce": repartition_reduce,
    "two_stage": two_stage,
    "collect_all": collect_all,
    "acc_count": acc_count,
    "acc_sum": acc_sum,
    "acc_compose": acc_compose,
    "parse_dsv": parse_dsv,
    "parse_dsv_nil": parse_dsv_nil,
    "parse_jsonl": parse_jsonl,
    "parse_jsonl_paths": parse_jsonl_paths,
    "file_decoder": file_decoder,
    "heatmap_custom_type": heatmap_custom_type,
    "row_error_skip": row_error_skip,
    "shuffle_error_skip": shuffle_error_skip,
    "custom_operation": custom_operation,
    "stream_reduce": stream_reduce,
    "group_partitions": group_partitions,
    "repartition_reduce_sizes": repartition_reduce_sizes,
    "collect_chunks": collect_chunks,
    "map_opaque": map_opaque,
    "flat_map_opaque": flat_map_opaque,
    "filter_opaque": filter_opaque,
    "for_each": for_each,
    "no_terminal": no_terminal,
    "custom_accumulator": custom_accumulator,
    "memory_buffers": memory_buffers,
    "custom_parser": custom_parser,
    "custom_source": custom_source_query,
    "listed_errors": listed_errors,
    "parse_header_lines": parse_header_lines,
    "parse_width": parse_width,
    "stream_timeout": stream_timeout,
    "stream_restart": stream_restart,
}

HOURS = "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"
FLAGS = """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, min(c) AS least, max(c) AS most
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) GROUP BY 1, 2"""
ORDERS = "o_orderkey, {0} AS o_custkey, {1} AS o_orderstatus, o_totalprice, o_orderpriority FROM orders"

ORACLE_SQL: dict[str, str] = {
    "add_column": "SELECT *, CAST(NULL AS VARCHAR) AS note FROM orders",
    "remove_column": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem",
    "rename_column": "SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "map_expr": "SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS flag, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS net FROM lineitem",
    "map_after_remove": "SELECT l_orderkey, l_linenumber, CAST(round(l_tax * 100) AS BIGINT) AS tax_percent FROM lineitem",
    "filter": "SELECT l_orderkey, l_linenumber, l_discount, l_returnflag FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag = 'R'",
    "flat_map": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    "flat_map_filter": "SELECT p_partkey, substr(p_name, CAST(i AS BIGINT), 1) AS letter FROM (SELECT *, unnest(range(1, p_size % 5 + 1)) AS i FROM part)",
    "reduce_count": "SELECT count(*) AS count FROM lineitem",
    "reduce_key_columns": FLAGS,
    "reduce_key_expr": HOURS,
    "reduce_distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "reduce_opaque": FLAGS,
    "group": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "repartition": "SELECT l_suppkey, CAST(ceil(n / 10.0) AS BIGINT) AS chunks, least(n, 10) AS largest, (n - 1) % 10 + 1 AS last FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)",
    "repartition_reduce": "SELECT l_suppkey, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1",
    "two_stage": "SELECT orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) GROUP BY 1",
    "collect_all": "SELECT * FROM nation",
    "acc_count": "SELECT count(*) AS n FROM lineitem",
    "acc_sum": "SELECT CAST(sum(l_linenumber) AS DOUBLE) AS total FROM lineitem",
    "acc_compose": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS total FROM lineitem",
    "parse_dsv": "SELECT " + ORDERS.format("o_custkey", "o_orderstatus"),
    "parse_dsv_nil": "SELECT " + ORDERS.format("CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END"),
    "parse_jsonl": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "parse_jsonl_paths": "SELECT event_id, user_id, event_type FROM events",
    "file_decoder": "SELECT o_orderkey, o_custkey FROM orders",
    "heatmap_custom_type": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, CAST(user_id % 16 AS INTEGER) AS cell, count(*) AS n FROM events GROUP BY 1, 2",
    "row_error_skip": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0",
    "shuffle_error_skip": "SELECT count(*) AS n, o_custkey % 10 AS digit FROM orders WHERE o_custkey >= 100 GROUP BY 2",
    "custom_operation": "SELECT p_partkey, p_brand, regexp_extract(p_brand, '[0-9]+') AS digits FROM part",
    "stream_reduce": f"SELECT count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM events GROUP BY event_id // {STREAM_BATCH}",
    "group_partitions": "SELECT l_orderkey, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM lineitem GROUP BY 1",
    "repartition_reduce_sizes": """WITH keys AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)
SELECT CAST(10 AS BIGINT) AS size, n // 10 AS chunks FROM keys WHERE n >= 10 UNION ALL SELECT n % 10, 1 FROM keys WHERE n % 10 > 0""",
    "collect_chunks": """WITH regions AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
SELECT n_regionkey, CAST(least(2, n - 2 * i) AS INTEGER) AS n, CAST(1 AS INTEGER) AS regions FROM (SELECT *, unnest(range(0, (n + 1) // 2)) AS i FROM regions)""",
    "map_opaque": "SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS flag, CAST(l_linenumber * 8 AS BIGINT) AS eighths FROM lineitem",
    "flat_map_opaque": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    "filter_opaque": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3",
    "for_each": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem",
    "no_terminal": """SELECT CAST(0 AS INTEGER) AS stage, count(DISTINCT o_custkey) AS n, true AS timed FROM orders
UNION ALL SELECT 1, count(DISTINCT o_custkey), true FROM orders WHERE o_custkey > 50""",
    "custom_accumulator": "SELECT p_name AS longest FROM part ORDER BY length(p_name) DESC, p_name LIMIT 1",
    "memory_buffers": "SELECT n_nationkey AS key, n_name AS name FROM nation",
    "custom_parser": "SELECT o_orderkey, o_custkey FROM orders",
    "custom_source": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "listed_errors": """SELECT 'Map' AS phase, 'ValueError: odd' AS cause, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT 'Reduction', 'ValueError: never', count(*) - count(DISTINCT o_orderstatus) FROM orders WHERE o_orderkey % 2 = 0""",
    "parse_header_lines": "SELECT o_orderkey, o_orderpriority FROM orders",
    "parse_width": """WITH cut AS (SELECT doc_id, substr(text, 1, 200) AS text FROM documents),
fits AS (SELECT doc_id, max(CASE WHEN strlen(substr(text, 1, n)) <= 20 THEN n ELSE 0 END) AS n, any_value(text) AS text FROM (SELECT *, unnest(range(0, 21)) AS n FROM cut) GROUP BY doc_id)
SELECT doc_id, CAST(strlen(substr(text, 1, n)) AS INTEGER) AS n_bytes, CAST(length(substr(text, 1, n)) AS INTEGER) AS n_chars FROM fits""",
    "stream_timeout": "SELECT unnest([false, true]) AS available, count(*) AS n FROM region",
    "stream_restart": "SELECT event_id FROM events",
}
