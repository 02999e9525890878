"""Sources: files, buffers in memory, tables and streams of generated records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..errors import SchemaError
from ..operators import col
from ..plans import Pipeline
from ..schema import Schema
from ..shipping import ship
from .parsers import DSV, JSONL

__all__ = ["DSV", "JSONL", "Parser", "Source", "custom_source", "file_source", "memory_source", "table_source"]


class Parser(Protocol):
    """What a parser has to offer; ``DSV`` and ``JSONL`` are two, any object with these methods is one."""

    def read_buffers(self, buffers: DataFrame, schema: Schema) -> DataFrame:
        """A column ``buffer`` of bytes to the schema's columns."""

    def read_files(self, spark: SparkSession, paths: Sequence[str] | str, schema: Schema) -> DataFrame:
        """Files to the schema's columns."""


def file_source(spark: SparkSession, pattern: str, parser: Parser, schema: Schema, decoder: Callable[[bytes], bytes] | None = None) -> Pipeline:
    """Files by a glob pattern; Spark raises if none matches.

    With a ``decoder`` each file is read as a whole and decoded in one task (decompressed,
    decrypted...) before it is parsed.
    """
    if decoder is None:
        return Pipeline.of(parser.read_files(spark, pattern, schema), schema)
    ship(spark)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([decoder(bytes(data))], pa.binary())], names=["buffer"])

    files = spark.read.format("binaryFile").load(pattern).select("content")
    return Pipeline.of(parser.read_buffers(files.mapInArrow(run, "buffer binary"), schema), schema)


def memory_source(spark: SparkSession, buffers: Sequence[bytes | str], parser: Parser, schema: Schema) -> Pipeline:
    """Buffers of the driver, each parsed on its own; a buffer may hold many lines."""
    rows = [(b.encode() if isinstance(b, str) else bytes(b),) for b in buffers]
    return Pipeline.of(parser.read_buffers(spark.createDataFrame(rows, "buffer binary"), schema), schema)


class Source(Protocol):
    """What a source of the user's has to offer."""

    def read(self, spark: SparkSession, parser: Parser | None, schema: Schema) -> DataFrame:
        """The data as the schema's columns: from a reader of Spark's, a registered data source, or
        buffers that the parser reads."""


def custom_source(spark: SparkSession, source: Source, schema: Schema, parser: Parser | None = None) -> Pipeline:
    """A pipeline over a source of the user's; its columns must be those of the schema, of their types."""
    df = source.read(spark, parser, schema)
    found, wanted = {f.name: f.dataType for f in df.schema}, {n: k.spark for n, k in schema}
    if found != wanted:
        raise SchemaError(f"the source has columns {found}, not {wanted}")
    return Pipeline.of(df.select(*map(col, schema.columns)), schema)


def table_source(df: DataFrame, schema: Schema | None = None) -> Pipeline:
    """Any DataFrame: Parquet, JDBC, a registered Python data source..."""
    return Pipeline.of(df, schema)
