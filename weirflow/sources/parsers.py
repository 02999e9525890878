"""Parsers: delimiter-separated values and JSON lines to typed columns.

Both read columns as text first and then convert them with expressions, so Catalyst prunes what
is not used.  A converting error ends the run; malformed rows are never dropped silently.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..operators import col
from ..schema import Schema
from ..shipping import ship
from ..types import ColumnType, spark_pattern

# The spellings of booleans that a cell may have.
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")


def _fail(name: str, kind: ColumnType, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"column {name}: not a {kind.name}: "), F.coalesce(text, F.lit("null"))))


def _ranged(name: str, kind: ColumnType, text: Column) -> Column:
    value = text.try_cast("decimal(38,0)")
    whole = text.rlike(r"^[+-]?[0-9]+$")
    return F.when(whole & value.between(F.lit(kind.low).cast("decimal(38,0)"), F.lit(kind.high).cast("decimal(38,0)")), value.cast(kind.spark)).otherwise(_fail(name, kind, text).cast(kind.spark))


@dataclass(frozen=True)
class DSV:
    """Delimiter-separated values with RFC 4180 quoting; columns are bound by position."""

    header_lines: int = 0
    delimiter: str = ","
    comment: str | None = None
    nil_value: str = ""
    nil_as_zero: bool = False
    multiline: bool = False

    def convert(self, name: str, kind: ColumnType, text: Column) -> Column:
        """A cell: nil if empty or ``nil_value``; an error if its type can't hold it."""
        nil = text.isNull() | (text == "") | (text == self.nil_value)
        n = kind.name
        if n in ("Byte", "Bytes"):
            raw = F.encode(text, "UTF-8")
            value = F.when(F.octet_length(text) <= kind.width, raw).otherwise(_fail(name, kind, text).cast("binary"))
        elif n == "Bool":
            value = F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).otherwise(_fail(name, kind, text).cast("boolean"))
        elif kind.low is not None:
            value = _ranged(name, kind, text)
        elif n in ("Float32", "Float64"):
            number = text.try_cast(kind.spark)
            value = F.coalesce(number, _fail(name, kind, text).cast(kind.spark))
        elif n == "String":
            value = _cut(text, kind.width)
        elif n == "Time":
            value = F.coalesce(F.try_to_timestamp(text, F.lit(spark_pattern(kind.layout))).cast("timestamp_ntz"), _fail(name, kind, text).cast("timestamp_ntz"))
        elif n == "VarString":
            value = text
        elif n == "VarBytes":
            value = F.encode(text, "UTF-8")
        else:
            raise SchemaError(f"column {name}: {n} can't be read from delimited values")
        return _nil(F.when(~nil, value), kind, self.nil_as_zero)

    def read_files(self, spark: SparkSession, paths: Sequence[str] | str, schema: Schema) -> DataFrame:
        """Files that Spark splits: records stand on one line each, and one that goes on in the next
        ends the run.  With ``multiline`` records may hold line ends, and each file is one task's."""
        if self.multiline and self.header_lines > 1:
            files = spark.read.format("binaryFile").load(paths).select(F.col("content").alias("buffer"))
            return self.read_buffers(files, schema)
        cells = T.StructType([T.StructField(n, T.StringType()) for n in schema.columns])
        options = {"sep": self.delimiter, "quote": '"', "escape": '"', "mode": "FAILFAST", "nullValue": "", "emptyValue": ""}
        if self.multiline:
            comment = {"comment": self.comment} if self.comment else {}
            read = spark.read.schema(cells).options(**options, **comment, multiLine=True, header=self.header_lines == 1, enforceSchema=True)
            return self._typed(read.csv(paths), schema)
        line = F.regexp_replace("value", "\r$", "")
        lines = file_lines(spark, paths, self.header_lines).where(line != "")
        if self.comment:
            lines = lines.where(~col("value").startswith(self.comment))
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        whole = F.when(quotes % 2 == 0, line).otherwise(F.raise_error(F.concat(F.lit("a quote is open at the end of a line (is it a multiline file?): "), line)).cast("string"))
        record = F.from_csv(whole, cells.simpleString(), options)
        return self._typed(lines.select(record.alias("_record")).select("_record.*"), schema)

    def read_buffers(self, buffers: DataFrame, schema: Schema) -> DataFrame:
        """A column ``buffer`` of whole buffers (bytes), each read by one task."""
        ship(buffers.sparkSession)
        names, options = list(schema.columns), self
        cells = T.StructType([T.StructField(n, T.StringType()) for n in names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    for rows in options._records(bytes(data).decode("utf-8"), len(names)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

        return self._typed(buffers.select("buffer").mapInArrow(run, cells), schema)

    def _records(self, text: str, width: int) -> Iterator[list[list[str]]]:
        lines = io.StringIO(text, newline="")
        kept = (x for x in lines if not (self.comment and x.startswith(self.comment)))
        held: list[list[str]] = []
        for k, record in enumerate(r for r in csv.reader(kept, delimiter=self.delimiter, strict=True) if r):
            if len(record) != width:
                raise ValueError(f"record {k + 1} has {len(record)} fields, not {width}")
            if k >= self.header_lines:
                held.append(record)
            if len(held) >= 4096:
                yield held
                held = []
        if held:
            yield held

    def _typed(self, cells: DataFrame, schema: Schema) -> DataFrame:
        return cells.select(*(self.convert(n, k, col(n)).alias(n, metadata=k.metadata()) for n, k in schema))


def _cut(text: Column, width: int) -> Column:
    """The longest beginning of whole characters that has at most ``width`` bytes."""
    some = F.length(F.substring(F.encode(text, "UTF-8"), 1, width).cast("string"))  # the last of these may be a part
    whole = F.when(F.octet_length(F.left(text, some)) <= width, some).otherwise(some - 1)
    return F.when(F.octet_length(text) <= width, text).otherwise(F.left(text, whole))


def _nil(value: Column, kind: ColumnType, as_zero: bool) -> Column:
    if not as_zero or kind.width is None:
        return value
    if kind.name in ("String", "Byte", "Bytes", "Time"):
        return value
    return F.coalesce(value, F.lit(0).cast(kind.spark) if kind.name != "Bool" else F.lit(False))


@dataclass(frozen=True)
class JSONL:
    """One JSON value per line; a column's name is the path of its value (dots between keys)."""

    header_lines: int = 0
    comment: str | None = None
    max_line: int = 64 * 1024
    nil_as_zero: bool = False

    def convert(self, name: str, kind: ColumnType, value: Column) -> Column:
        """An absent or null value is nil; numbers, numeric strings and booleans are coerced."""
        path = "$" + "".join(f"['{p}']" for p in name.split("."))
        found = F.try_variant_get(value, path, "variant")
        there = found.isNotNull() & ~F.is_variant_null(found)
        n = kind.name
        if n in ("Int8", "Int16", "Int32", "Int64"):
            whole = F.coalesce(F.try_variant_get(value, path, "bigint"), F.lit(0).cast("bigint"))
            out = _wrapped(whole, kind)
        elif n in ("Float32", "Float64"):
            out = F.coalesce(F.try_variant_get(value, path, "double"), F.lit(0.0)).cast(kind.spark)
        elif n == "Bool":
            text = F.try_variant_get(value, path, "string")
            number = F.try_variant_get(value, path, "double")
            out = F.coalesce(number != 0, ~text.isin("", "0", "false"), F.lit(False))
            out = F.when(text == "true", True).when(text == "false", False).otherwise(out)
        elif n == "String":
            out = _cut(F.try_variant_get(value, path, "string"), kind.width)
        elif n == "VarString":
            out = F.try_variant_get(value, path, "string")
        elif n == "Time":
            text = F.try_variant_get(value, path, "string")
            out = F.coalesce(F.try_to_timestamp(text, F.lit(spark_pattern(kind.layout))).cast("timestamp_ntz"), _fail(name, kind, text).cast("timestamp_ntz"))
        else:
            raise SchemaError(f"column {name}: {n} can't be read from JSON lines")
        return _nil(F.when(there, out), kind, self.nil_as_zero)

    def parse(self, lines: DataFrame, schema: Schema, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
        """Lines of text to typed columns; columns to keep stand behind them."""
        line = F.regexp_replace(col(column), "\r$", "")
        if self.comment:
            lines = lines.where(~F.coalesce(col(column).startswith(self.comment), F.lit(False)))
        checked = F.when(F.octet_length(line) <= self.max_line, line).otherwise(F.raise_error(F.lit(f"a line is longer than {self.max_line} bytes")).cast("string"))
        parsed = lines.select(F.try_parse_json(checked).alias("_value"), *map(col, keep))
        return parsed.select(*(self.convert(n, k, F.col("_value")).alias(n, metadata=k.metadata()) for n, k in schema), *map(col, keep))

    def read_files(self, spark: SparkSession, paths: Sequence[str] | str, schema: Schema) -> DataFrame:
        return self.parse(file_lines(spark, paths, self.header_lines), schema)

    def read_buffers(self, buffers: DataFrame, schema: Schema) -> DataFrame:
        return self.parse(_lines(buffers.select(F.decode("buffer", "UTF-8").alias("value")), "value", self.header_lines), schema)


def file_lines(spark: SparkSession, paths: Sequence[str] | str, skip: int) -> DataFrame:
    """The lines (column value) of files, without the first ``skip`` of each; Spark splits the files.

    The lines to skip stand at the beginning of a file's first block, which a task reads in
    order; they must lie in that block.
    """
    lines = spark.read.text(paths, lineSep="\n")
    if not skip:
        return lines
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, 0
        for batch in batches:
            values, keep = batch.column(0), []
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if path != file:
                    file, seen = path, 0
                keep.append(start > 0 or seen >= skip)
                seen += 1
            yield pa.RecordBatch.from_arrays([values.filter(pa.array(keep))], names=["value"])

    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return placed.mapInArrow(run, "value string")


def _wrapped(value: Column, kind: ColumnType) -> Column:
    """An integer narrowed to the type's width, wrapping around."""
    if kind.width == 8:
        return value
    span, half = 1 << 8 * kind.width, 1 << 8 * kind.width - 1
    return (F.pmod(F.pmod(value, F.lit(span)) + half, F.lit(span)) - half).cast(kind.spark)


def _lines(whole: DataFrame, column: str, skip: int) -> DataFrame:
    """The lines of whole texts after the first ``skip``; what follows the last line's end is none."""
    text = F.regexp_replace(col(column), "\n$", "")
    split = whole.where(F.length(col(column)) > 0).select(F.posexplode(F.split(text, "\n")).alias("at", "value"))
    return split.where(F.col("at") >= skip).select("value")
