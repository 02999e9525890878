"""Pipelines: a chain of operations, checked as it is built and compiled to one DataFrame."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RowError, RunTimeout, SchemaError
from ..operators import Accumulate, AddColumn, Collect, Custom, Filter, FlatMap, ForEach, Group, Map, Operation, Reduce, RemoveColumn, RenameColumn, check, col
from ..rows import ERROR, Row, apply_rows, arrow_fields, log, read_rows, read_values, to_batch
from ..schema import Schema, schema_of
from ..shipping import ship

#: Keys, and bytes of rows, that a task folds before it gives out what it has.
FOLD_KEYS, FOLD_BYTES = 100_000, 64 << 20
#: Seconds that a cancelled run's tasks have to end.
STOP_SECONDS = 10
#: The column that numbers the chunks of a repartitioning while a pipeline is compiled.
CHUNK = "_chunk"
#: The hash of a reduction's key, where its results are dealt in chunks.
HASH = "_hash"


@dataclass
class RunOptions:
    """How a pipeline runs.

    ``timeout``: seconds after which ``run`` cancels its jobs and raises RunTimeout.
    ``count_rows``: ``run`` counts the rows that each stage gives out (``stats["rows"]``); filters
    are then not pushed through the ends of stages.
    ``strict_keys``: a missing value in a key column ends the run; otherwise missing values are a
    key of their own.
    ``log_errors``: of the errors of rows that are left out, ``run`` gives at most so many to the
    driver's logger ``weirflow``, wherever they come up.
    """

    ignore_row_errors: bool = False
    partition_size: int = 128
    timeout: float | None = None
    count_rows: bool = False
    strict_keys: bool = False
    log_errors: int = 20
    note: Callable[[str], None] | None = field(default=None, repr=False, compare=False)


@dataclass
class Result:
    """What a run returns: an accumulated value, or collected rows; and its statistics.

    ``chunks``: the collected rows by chunk, after a repartitioning.  ``stats``: seconds; stages;
    rows by stage, if they are counted; and of each of Spark's stages, in order: how many
    partitions it had (partitions), its time (stage_seconds), that of its tasks without and in
    writing its shuffle (transform_seconds, shuffle_seconds) and the mean of a partition's
    (partition_seconds).
    """

    accumulated: Any = None
    collected: list[T.Row] | None = None
    chunks: list[list[T.Row]] | None = None
    stats: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    """A source and a chain of operations."""

    source: DataFrame
    schema: Schema
    operations: tuple[Operation, ...] = ()
    source_schema: Schema | None = None

    @staticmethod
    def of(df: DataFrame, schema: Schema | None = None) -> Pipeline:
        schema = schema or schema_of(df.schema)
        return Pipeline(df, schema, (), schema)

    def to(self, *operations: Operation) -> Pipeline:
        """The pipeline with more operations; raises at once where one does not fit."""
        out = self
        for op in operations:
            if out.operations and out.operations[-1].ends:
                raise SchemaError("no operation can follow one that ends the pipeline")
            if isinstance(op, Collect) and out.source.isStreaming:
                raise SchemaError("a stream can't be collected")
            schema = out.schema
            if isinstance(op, Custom):
                schema = op.do(_blank(out.source, schema), schema.repack())[1]
            else:
                schema = check(op, schema)
            if op.shuffles or op.ends:
                schema = schema.repack()
            out = replace(out, schema=schema, operations=(*out.operations, op))
        return out

    def stages(self) -> list[list[Operation]]:
        """Operations by stage: a stage ends with a shuffle; columns are added at its start."""
        stages: list[list[Operation]] = [[]]
        for op in self.operations:
            stages[-1].append(op)
            if op.shuffles:
                stages.append([])
        return [sorted(s, key=lambda op: not isinstance(op, AddColumn)) for s in stages if s]

    def dataframe(self, options: RunOptions | None = None, source: DataFrame | None = None) -> DataFrame:
        """The compiled frame, without the operation that ends the pipeline."""
        df, _ = self._compile(options or RunOptions(), source)
        return df.drop(CHUNK)

    def chunked(self, options: RunOptions | None = None, name: str = "chunk") -> DataFrame:
        """The frame of a pipeline whose last shuffle is a repartitioning, with one column more:
        the chunk of the row (a struct, the same for the rows of one chunk)."""
        if not self._sized():
            raise SchemaError("the pipeline does not end with a repartitioning")
        df, _ = self._compile(options or RunOptions(), None)
        return df.withColumnRenamed(CHUNK, name)

    def _sized(self) -> int | None:
        """The size of the chunks that the pipeline's last operation (but for its end) deals."""
        last = [op for op in self.operations if not op.ends][-1:]
        return getattr(last[0], "size", None) if last else None

    def errors(self, options: RunOptions | None = None) -> DataFrame:
        """The messages of all rows that were left out: column error."""
        found: list[DataFrame] = []
        self._compile(replace(options or RunOptions(), ignore_row_errors=True), None, found)
        out = found[0] if found else self.source.sparkSession.createDataFrame([], "error string")
        for f in found[1:]:
            out = out.union(f)
        return out

    def _compile(self, options: RunOptions, source: DataFrame | None, errors: list[DataFrame] | None = None, counts: list[Observation] | None = None) -> tuple[DataFrame, Schema]:
        df, schema = source if source is not None else self.source, (self.source_schema or self.schema).clone()
        for stage in self.stages():
            for op in stage:
                if op.ends:
                    break
                if CHUNK in df.columns:
                    df = df.drop(CHUNK)
                if op.shuffles and not isinstance(op, Custom):
                    kept = schema.repack()
                    # the key may read columns that go at the end of this stage
                    df = _shuffle(df, schema, kept, op, options, errors)
                    schema = kept
                else:
                    df, schema = _narrow(df, schema, op, options, errors)
            if schema.removed:
                df = df.drop(*(n for n in schema.removed))
                schema = schema.repack()
            if counts is not None:
                counts.append(Observation())
                df = df.observe(counts[-1], F.count(F.lit(1)).alias("rows"))
        return df, schema

    def run(self, options: RunOptions | None = None) -> Result:
        """Run the pipeline; what it returns depends on its last operation."""
        options = options or RunOptions()
        with _deadline(self.source.sparkSession, options.timeout):
            return self._run(options)

    def _run(self, options: RunOptions) -> Result:
        began, first_job = time.time(), _next_job(self.source.sparkSession)
        counts: list[Observation] | None = [] if options.count_rows else None
        if options.ignore_row_errors and options.log_errors:
            found = self.source.sparkSession.sparkContext.accumulator([], _Messages(options.log_errors))
            options = replace(options, note=lambda text: found.add([text]))
        df, schema = self._compile(options, None, counts=counts)
        last = self.operations[-1] if self.operations else None
        result = Result()
        if isinstance(last, Collect) and self._sized():
            chosen = df.select(CHUNK).distinct().limit(last.partitions)  # so many rows, whatever the input
            got: dict[Any, list[T.Row]] = {}
            for r in df.join(chosen, df[CHUNK].eqNullSafe(chosen[CHUNK]), "left_semi").collect():
                got.setdefault(r[CHUNK], []).append(_without(r, CHUNK))
            result.chunks = list(got.values())
            result.collected = [r for c in result.chunks for r in c]
        elif isinstance(last, Collect):
            result.collected = df.limit(last.partitions * options.partition_size).collect()
        elif isinstance(last, Accumulate):
            result.accumulated = accumulate(df, schema, last.factory)
        elif isinstance(last, ForEach):
            do, frozen = last.do, schema
            ship(df.sparkSession)

            def effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in read_rows(batch, frozen):
                        do(row)
                    yield from ()

            df.mapInArrow(effect, "done boolean").write.format("noop").mode("overwrite").save()
        else:
            df.write.format("noop").mode("overwrite").save()
        result.stats = {"seconds": time.time() - began, "stages": len(self.stages())} | _stage_times(self.source.sparkSession, first_job)
        if options.note is not None:
            for text in found.value:
                log.error(text)
        if counts is not None:
            result.stats["rows"] = [o.get["rows"] for o in counts]
        return result


class _Messages(AccumulatorParam):
    """The first ``most`` of the messages that tasks send."""

    def __init__(self, most: int):
        self.most = most

    def zero(self, value: list[str]) -> list[str]:
        return []

    def addInPlace(self, value1: list[str], value2: list[str]) -> list[str]:  # noqa: N802
        return (value1 + value2)[: self.most]


def _without(row: T.Row, name: str) -> T.Row:
    return T.Row(**{k: v for k, v in zip(row.__fields__, row, strict=True) if k != name})


def _next_job(spark: SparkSession) -> int:
    jobs = spark.sparkContext._jsc.sc().statusStore().jobsList(None)
    return jobs.head().jobId() + 1 if jobs.nonEmpty() else 0


def _stages_since(spark: SparkSession, first_job: int) -> Iterator[Any]:
    """What Spark's status says of the stages that jobs from ``first_job`` on have run, in order."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs, ids = store.jobsList(None).iterator(), set()
    while jobs.hasNext():
        job = jobs.next()
        if job.jobId() >= first_job:
            stages = job.stageIds().iterator()
            while stages.hasNext():
                ids.add(int(stages.next()))
    for i in sorted(ids):
        try:
            yield store.lastStageAttempt(i)
        except Exception:  # noqa: S112, BLE001  (a stage whose result was there already has no attempt)
            continue


def _stage_times(spark: SparkSession, first_job: int) -> dict[str, list]:
    """Partitions and times of the stages that jobs from ``first_job`` on have run."""
    out: dict[str, list] = {"partitions": [], "stage_seconds": [], "transform_seconds": [], "shuffle_seconds": [], "partition_seconds": []}
    for stage in _stages_since(spark, first_job):
        tasks, whole = stage.numCompleteTasks(), stage.executorRunTime() / 1e3
        if tasks:
            shuffle = stage.shuffleWriteTime() / 1e9
            ends = stage.submissionTime(), stage.completionTime()
            out["partitions"].append(tasks)
            out["stage_seconds"].append((ends[1].get().getTime() - ends[0].get().getTime()) / 1e3 if all(e.isDefined() for e in ends) else 0.0)
            out["transform_seconds"].append(max(0.0, whole - shuffle))
            out["shuffle_seconds"].append(shuffle)
            out["partition_seconds"].append(whole / tasks)
    return out


@contextmanager
def _deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancels the jobs started within once ``seconds`` are over, and waits for their tasks to end."""
    if seconds is None:
        yield
        return
    first_job = _next_job(spark)
    context, tag, late = spark.sparkContext, f"weirflow-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            given_up = time.time() + STOP_SECONDS
            while time.time() < given_up and any(stage.numActiveTasks() for stage in _stages_since(spark, first_job)):
                time.sleep(0.1)
            raise RunTimeout(f"stopped after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _blank(df: DataFrame, schema: Schema) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema.repack().struct())


def _split(df: DataFrame, schema: Schema, errors: list[DataFrame] | None, options: RunOptions) -> DataFrame:
    if errors is not None:
        errors.append(df.where(F.col(ERROR).isNotNull()).select(F.col(ERROR).alias("error")))
    return df.where(F.col(ERROR).isNull()).select(*map(col, schema.columns)) if options.ignore_row_errors else df.select(*map(col, schema.columns))


def _narrow(df: DataFrame, schema: Schema, op: Operation, options: RunOptions, errors: list[DataFrame] | None) -> tuple[DataFrame, Schema]:
    ignore = options.ignore_row_errors
    if isinstance(op, Custom):
        return op.do(df, schema)
    after = check(op, schema)
    if isinstance(op, AddColumn):
        return df.withColumn(op.name, F.lit(None).cast(op.kind.spark)), after
    if isinstance(op, RemoveColumn):
        return df, after
    if isinstance(op, RenameColumn):
        return df.withColumnRenamed(op.old, op.new), after
    if isinstance(op, Map):
        if isinstance(op.what, dict):
            made = {n: c.cast(schema.get_column(n).spark) for n, c in op.what.items()}
            return df.select(*(made[n].alias(n) if n in made else col(n) for n in schema.columns)), after
        do = op.what

        def each(row: Row, new: Callable[[], Row]) -> Iterator[Row]:
            do(row)
            yield row

        return _split(apply_rows(df, schema, "Map", each, ignore, options.note), schema, errors, options), after
    if isinstance(op, Filter):
        if isinstance(op.what, Column):
            return df.where(op.what), after
        holds = op.what

        def keep(row: Row, new: Callable[[], Row]) -> Iterator[Row]:
            if holds(row):
                yield row

        return _split(apply_rows(df, schema, "Filter", keep, ignore, options.note), schema, errors, options), after
    if isinstance(op, FlatMap):
        if isinstance(op.what, Column):
            made = df.select(*map(col, op.keep), F.explode(op.what).alias("_made"))
            if op.into:
                fields = {op.into: F.col("_made")}
            else:
                fields = {f: F.col("_made")[f] for f in made.schema["_made"].dataType.names}
            fields |= {n: col(n) for n in op.keep}
            return made.select(*((fields[n] if n in fields else F.lit(None)).cast(k.spark).alias(n) for n, k in schema)), after
        spread = op.what

        def emit(row: Row, new: Callable[[], Row]) -> Iterator[Row]:
            made: list[Row] = []

            def factory() -> Row:
                made.append(new())
                return made[-1]

            spread(row, factory)
            yield from made

        return _split(apply_rows(df, schema, "FlatMap", emit, ignore, options.note), schema, errors, options), after
    raise SchemaError(f"unknown operation {op!r}")


def _shuffle(df: DataFrame, schema: Schema, kept: Schema, op: Group | Reduce, options: RunOptions, errors: list[DataFrame] | None) -> DataFrame:
    if options.strict_keys and not _opaque(op.key) and not isinstance(op.key, Column):
        df = df.withColumns({n: F.when(col(n).isNotNull(), col(n)).otherwise(F.raise_error(F.lit(f"Keying failed: column {n} has no value")).cast(df.schema[n].dataType)) for n in op.key})
    if isinstance(op, Reduce):
        if isinstance(op.merge, dict) and not _opaque(op.key):
            out = _reduce(df, kept, op)
        else:
            out = _fold(df, schema, kept, op, options, errors)
        return _dealt(out, [], op.size, col(HASH)).select(*map(col, kept.columns), CHUNK) if op.size else out
    keyed = df if not _opaque(op.key) else _python_key(df, schema, op.key, options, errors)
    names, key = _key(op.key)
    keyed = keyed.withColumns(key)
    if op.size:
        hashed = [col(f.name) for f in keyed.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
        return _dealt(keyed, names, op.size, F.xxhash64(*hashed)).select(*map(col, kept.columns), CHUNK)
    out = keyed.repartition(*map(col, names)).sortWithinPartitions(*map(col, names))
    return out.select(*map(col, kept.columns))


def _dealt(df: DataFrame, keys: Sequence[str], size: int, hashed: Column) -> DataFrame:
    """``df`` dealt by CHUNK: the key and the number of the row's chunk of ``size`` rows in it.

    Rows are numbered within their key and a salt from their hash, then moved on by how many
    rows the key's salts before have; so no key, however common, is numbered in one task.  The
    frame is read twice, for the counts and for the rows.
    """
    spread = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(hashed, F.lit(spread)).cast("int"))
    same = [col(k) for k in keys]
    counts = salted.groupBy(*same, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*same).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    met = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = F.col("_salt") == F.col("_s")
    for m in met:
        on = on & m
    placed = salted.join(starts, on)
    number = F.col("_start") + F.row_number().over(Window.partitionBy(*same, "_salt").orderBy(F.lit(0))) - 1
    chunk = F.struct(*(col(k).alias(f"key{i}") for i, k in enumerate(keys)), F.floor(number / size).cast("long").alias("number"))
    return placed.withColumn(CHUNK, chunk).repartition(CHUNK).sortWithinPartitions(CHUNK)


def _opaque(key: Any) -> bool:
    return callable(key) and not isinstance(key, Column)


def _key(key: Any) -> tuple[list[str], dict[str, Column]]:
    if isinstance(key, Column):
        return ["_key"], {"_key": key}
    if _opaque(key):
        return ["_key"], {}
    return list(key), {}


def _reduce(df: DataFrame, kept: Schema, op: Reduce) -> DataFrame:
    """Aggregate expressions: partial and final hash aggregation."""
    names, key = _key(op.key)
    keys = [col(n) for n in names] if not key else [key["_key"].alias("_key")]
    aggs = []
    for n, k in kept:
        if n in op.merge:
            aggs.append(op.merge[n].cast(k.spark).alias(f"_agg_{n}"))
        elif n not in names:
            aggs.append(F.any_value(col(n)).alias(f"_agg_{n}"))
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    made = [col(n) if n in names and n not in op.merge else col(f"_agg_{n}").alias(n) for n in kept.columns]
    return out.select(*made, *([F.xxhash64(*map(col, names)).alias(HASH)] if op.size else []))


def _python_key(df: DataFrame, schema: Schema, key: Callable[[Row], bytes], options: RunOptions, errors: list[DataFrame] | None) -> DataFrame:
    from ..types import VarBytes

    widened = schema.clone().create_column("_key", VarBytes)

    def each(row: Row, new: Callable[[], Row]) -> Iterator[Row]:
        row.values["_key"] = bytes(key(row))
        yield row

    return _split(apply_rows(df.withColumn("_key", F.lit(None).cast("binary")), widened, "Keying", each, options.ignore_row_errors, options.note), widened, errors, options)


def _fold(df: DataFrame, schema: Schema, kept: Schema, op: Reduce, options: RunOptions, errors: list[DataFrame] | None) -> DataFrame:
    """An opaque reduction: folded within each task, dealt by key, sorted and folded again.

    A row on which the function fails is left out; its error travels as a row of its own.
    """
    from ..types import Int64, VarBytes, VarString

    ship(df.sparkSession)
    if _opaque(op.key):
        keyed = _python_key(df, schema, op.key, options, errors)
    else:
        names, key = _key(op.key)
        # a typed, null-safe rendering of the key's values
        made = key["_key"] if key else F.struct(*(col(n) for n in names))
        keyed = df.withColumn("_key", F.to_json(F.struct(made.alias("k")), {"ignoreNullFields": "false"}).cast("binary"))
    widened = kept.clone().create_column("_key", VarBytes).create_column(ERROR, VarString)
    struct, ignore = widened.struct(), options.ignore_row_errors
    fields = arrow_fields(struct)
    merge, note = op.merge, options.note
    if isinstance(merge, dict):
        raise SchemaError("a reduction with a Python key needs a Python function")

    def join(left: Row, right: Row, failed: list[dict[str, Any]]) -> Row:
        before = dict(left.values) if ignore else None
        try:
            merge(left, right)
        except Exception as e:
            if not ignore:
                raise RowError("Reduction", right.to_string(), f"{type(e).__name__}: {e}") from e
            failed.append({"_key": before["_key"], ERROR: f"Reduction failed on row {right.to_string()}: {type(e).__name__}: {e}"})
            if note is not None:
                note(failed[-1][ERROR])
            left.values = before
        return left

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Row] = {}
        size, failed, right = 0, [], Row(widened, {})  # one view serves all rows that are merged into others
        for batch in batches:
            for values in read_values(batch, widened):
                left = held.get(values["_key"])
                if left is None:
                    held[values["_key"]] = Row(widened, values)
                else:
                    right.values = values
                    join(left, right, failed)
            size += batch.nbytes
            if len(held) >= FOLD_KEYS or size >= FOLD_BYTES or failed:
                yield to_batch([r.values for r in held.values()] + failed, widened, fields)
                held, size, failed = {}, 0, []
        if held or failed:
            yield to_batch([r.values for r in held.values()] + failed, widened, fields)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for row in read_rows(batch, widened):
                if row.values[ERROR] is not None:  # failed in a task that folded
                    out.append(row.values)
                elif now is not None and now.values["_key"] == row.values["_key"]:
                    now = join(now, row, out)
                else:
                    if now is not None:
                        out.append(now.values)
                    now = row
            if len(out) >= 4096:
                yield to_batch(out, widened, fields)
                out = []
        if now is not None:
            out.append(now.values)
        if out:
            yield to_batch(out, widened, fields)

    ready = keyed.select(*map(col, [*kept.columns, "_key"]))
    dealt = ready.withColumn(ERROR, F.lit(None).cast("string")).mapInArrow(combine, struct).repartition("_key").sortWithinPartitions("_key")
    done = dealt.mapInArrow(finish, struct)
    if op.size:
        done, kept = done.withColumn(HASH, F.xxhash64("_key")), kept.clone().create_column(HASH, Int64)
    return _split(done, kept, errors, options)


def accumulate(df: DataFrame, schema: Schema, factory: Callable[[], Any]) -> Any:
    """Fold all rows: aggregate expressions where the accumulator has them, else partial folds."""
    total = factory()
    found = total.expressions(schema)
    if found is not None:
        row = df.agg(*(c.alias(f"_{i}") for i, c in enumerate(found))).first()
        total.take(list(row))
        return total.value()
    ship(df.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = factory()
        for batch in batches:
            for row in read_rows(batch, schema):
                part.accumulate(row)
        yield pa.RecordBatch.from_arrays([pa.array([part.to_bytes()], pa.binary())], names=["part"])

    for r in df.mapInArrow(fold, "part binary").toLocalIterator():
        total.merge(factory().from_bytes(bytes(r.part)))
    return total.value()
