"""Micro-batch streams: generators as a source, and pipelines that run on every batch.

Nothing is carried from batch to batch: a reduction sees the records of its own batch.  Spark may
take several batches at once, whose rows a column then holds apart.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import StreamTimeout
from ..operators import Collect, Custom, FlatMap, Group, Operation, Reduce, col
from ..plans import Pipeline, RunOptions
from ..rows import Row
from ..schema import Schema
from ..shipping import shared_root, ship
from ..types import Int64

#: The column that numbers the batches which Spark takes at once.
BATCH = "_batch"
#: Records of a generator that one task makes.
SPAN_RECORDS = 25_000

Generator = Callable[[int], str]


def generator_source(spark: SparkSession, generators: Sequence[Generator], batch_size: int, limit: int | None = None, name: str | None = None, checkpoint: str | None = None, at_once: int = 1) -> DataFrame:
    """A stream of lines (column value): each batch takes ``batch_size`` records of each generator.

    A generator is a function of the record's number, so a lost task can be run again.
    ``limit``: batches after which the stream has no more records.  ``checkpoint``: the folder of
    an earlier run, after whose records the stream goes on.  Sources without a ``name`` get one
    of their own.  ``at_once``: so many batches are taken at once at most, which saves the time that
    Spark needs for each start; a second column numbers them (from 0), and ``run_stream`` keeps
    each batch's rows apart by it.
    """
    ship(spark)
    made, size, most, name = list(generators), batch_size, limit, name or f"generators_{uuid.uuid4().hex}"
    several, span, columns = at_once, SPAN_RECORDS, f"value string, {BATCH} long" if at_once > 1 else "value string"
    planned = _planned(spark, checkpoint) if checkpoint else 0

    # all classes are local: Spark's planner of streams need not find this package

    class Span(InputPartition):
        def __init__(self, generator: int, first: int, start: int, end: int):
            self.generator, self.first, self.start, self.end = generator, first, start, end

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.at = planned

        def initialOffset(self) -> dict:
            return {"record": 0}

        def latestOffset(self) -> dict:
            left = several if most is None else -((self.at - most * size) // size)
            self.at += size * max(0, min(several, left))
            return {"record": self.at}

        def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
            first, last = start["record"], end["record"]
            return [Span(i, first, k, min(k + span, last)) for i in range(len(made)) for k in range(first, last, span)]

        def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
            for k in range(partition.start, partition.end):
                record = made[partition.generator](k)
                yield (record, (k - partition.first) // size) if several > 1 else (record,)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def _planned(spark: SparkSession, checkpoint: str) -> int:
    """The record up to which the runs with this checkpoint have planned their batches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return 0
    last = spark.read.text(f"{checkpoint}/offsets").where(F.col("value").startswith('{"record"'))
    found = last.agg(F.max(F.get_json_object("value", "$.record").cast("long"))).first()[0]
    return found or 0


def stream_pipeline(lines: DataFrame, parser, schema: Schema) -> Pipeline:
    """A pipeline over a stream of lines."""
    held = {"keep": (BATCH,)} if BATCH in lines.columns else {}
    return Pipeline.of(parser.parse(lines, schema, **held), schema)


def _apart(pipeline: Pipeline) -> Pipeline:
    """The pipeline on several batches at once: each keeps to its own rows, and the results have
    the batch's number as a last column."""
    before, after = (s.clone().create_column(BATCH, Int64) for s in (pipeline.source_schema or pipeline.schema, pipeline.schema))
    return replace(pipeline, schema=after, operations=tuple(map(_within, pipeline.operations)), source_schema=before)


def _within(op: Operation) -> Operation:
    """The operation within each batch."""
    if isinstance(op, Custom):
        raise ValueError("a custom operation sees one batch at a time: its source must have at_once=1")
    if isinstance(op, Group | Reduce):
        key = op.key
        if isinstance(key, Column):
            return replace(op, key=F.struct(col(BATCH), key))
        if not callable(key):
            return replace(op, key=(BATCH, *key))
        return replace(op, key=lambda row: row[BATCH].to_bytes(8, "big") + bytes(key(row)))
    if isinstance(op, FlatMap) and isinstance(op.what, Column):
        return replace(op, keep=(*op.keep, BATCH))
    if isinstance(op, FlatMap):
        spread = op.what

        def emit(row: Row, factory: Callable[[], Row]) -> None:
            def new() -> Row:
                made = factory()
                made[BATCH] = row[BATCH]
                return made

            spread(row, new)

        return FlatMap(emit)
    return op


def run_stream(pipeline: Pipeline, sink: Callable[[DataFrame, int], None], timeout: float | None = None, options: RunOptions | None = None, available: bool = False, checkpoint: str | None = None) -> None:
    """Run the pipeline's operations on each micro-batch and hand its result to ``sink``.

    Ends when the source has no more records (``available``), or with StreamTimeout after
    ``timeout`` seconds.  ``checkpoint``: a folder that driver and executors share; a later run
    with the same one goes on after the batches that this one has finished.  By default a new
    folder below ``spark.checkpoint.dir``.  Of a source that gives several batches at once ``sink``
    gets their results together, with the batch of each row in the column ``_batch``.
    """
    if any(isinstance(op, Collect) for op in pipeline.operations):
        raise ValueError("a stream can't be collected")
    pipeline = _apart(pipeline) if BATCH in pipeline.source.columns else pipeline

    def batch(df: DataFrame, number: int) -> None:
        sink(pipeline.dataframe(options, source=df), number)

    checkpoint = checkpoint or f"{shared_root(pipeline.source.sparkSession)}/weirflow-stream-{uuid.uuid4().hex}"
    query = pipeline.source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
    began, done = time.time(), threading.Event()

    def wait() -> None:
        try:
            query.processAllAvailable()
        except Exception:  # noqa: S110, BLE001  (stopped, or failed: then the query's own exception is raised below)
            pass
        finally:
            done.set()

    if available:
        threading.Thread(target=wait, daemon=True).start()
    try:
        while query.isActive and not done.is_set():
            if timeout is not None and time.time() - began >= timeout:
                raise StreamTimeout(f"stopped after {timeout} seconds")
            query.awaitTermination(0.2)
    finally:
        query.stop()
        if query.exception() is not None:
            raise query.exception()
