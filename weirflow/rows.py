"""Opaque Python row functions over Arrow batches, with errors held apart row by row.

A failing row is left out and its error goes, with phase and row text, to a second column of the
same pass; without ``ignore_row_errors`` the first failure ends the run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import NilValueError, RowError, SchemaError
from .schema import Schema
from .shipping import ship
from .types import Custom

log = logging.getLogger("weirflow")


class Row:
    """A view of one row for row functions: typed values by column name."""

    __slots__ = ("schema", "values")

    def __init__(self, schema: Schema, values: dict[str, Any]):
        self.schema, self.values = schema, values

    def get(self, name: str) -> Any:
        """The value; NilValueError if there is none."""
        try:
            value = self.values[name]
        except KeyError:
            raise SchemaError(f"column {name} does not exist") from None
        if value is None:
            raise NilValueError(name)
        return value

    def set(self, name: str, value: Any) -> None:
        kind = self.schema.columns.get(name) or self.schema.get_column(name)
        self.values[name] = kind.check(value)

    def is_nil(self, name: str) -> bool:
        return self.values[name] is None

    def set_nil(self, name: str) -> None:
        self.schema.get_column(name)
        self.values[name] = None

    __getitem__, __setitem__ = get, set

    def to_string(self) -> str:
        return "{" + ", ".join(f"{n}: {k.text(self.values.get(n))}" for n, k in self.schema) + "}"

    def _typed(*names: str):  # noqa: N805
        def getter(self: Row, name: str) -> Any:
            kind = self.schema.get_column(name).name
            if kind not in names:
                raise SchemaError(f"column {name} is {kind}, not {names[0]}")
            return self.get(name)

        def setter(self: Row, name: str, value: Any) -> None:
            kind = self.schema.get_column(name).name
            if kind not in names:
                raise SchemaError(f"column {name} is {kind}, not {names[0]}")
            self.set(name, value)

        return getter, setter

    get_byte, set_byte = _typed("Byte")
    get_bytes, set_bytes = _typed("Bytes")
    get_bool, set_bool = _typed("Bool", "boolean")
    get_uint8, set_uint8 = _typed("Uint8")
    get_uint16, set_uint16 = _typed("Uint16")
    get_uint32, set_uint32 = _typed("Uint32")
    get_uint64, set_uint64 = _typed("Uint64")
    get_int8, set_int8 = _typed("Int8", "byte")
    get_int16, set_int16 = _typed("Int16", "short")
    get_int32, set_int32 = _typed("Int32", "integer")
    get_int64, set_int64 = _typed("Int64", "long")
    get_float32, set_float32 = _typed("Float32", "float")
    get_float64, set_float64 = _typed("Float64", "double")
    get_time, set_time = _typed("Time", "timestamp_ntz", "timestamp")
    get_string, set_string = _typed("String")
    get_var_string, set_var_string = _typed("VarString", "string")
    get_var_bytes, set_var_bytes = _typed("VarBytes", "binary")
    del _typed

    def get_var_custom(self, name: str) -> Any:
        return self.get(name)

    def set_var_custom(self, name: str, value: Any) -> None:
        self.set(name, value)


ERROR = "_row_error"


def read_values(batch: pa.RecordBatch, schema: Schema) -> Iterator[dict[str, Any]]:
    """The rows of a batch as values by column name, with the user's types decoded."""
    names = batch.schema.names
    codecs = {n: k.decode for n, k in schema if isinstance(k, Custom) and k.decode}
    maps = {n for n, k in schema if isinstance(k.spark, T.MapType)}
    rows = (dict(zip(names, values, strict=True)) for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True))
    if not codecs and not maps:
        yield from rows
        return
    for row in rows:
        for n in maps:
            row[n] = None if row.get(n) is None else dict(row[n])
        for n, decode in codecs.items():
            row[n] = None if row.get(n) is None else decode(row[n])
        yield row


def read_rows(batch: pa.RecordBatch, schema: Schema) -> Iterator[Row]:
    return (Row(schema, values) for values in read_values(batch, schema))


def to_batch(rows: list[dict[str, Any]], schema: Schema, fields: pa.Schema) -> pa.RecordBatch:
    codecs = {n: k.encode for n, k in schema if isinstance(k, Custom) and k.encode}
    arrays = []
    for f in fields:
        column = [r.get(f.name) for r in rows]
        if f.name in codecs:
            column = [None if v is None else codecs[f.name](v) for v in column]
        if pa.types.is_map(f.type):
            column = [None if v is None else list(v.items()) for v in column]
        arrays.append(pa.array(column, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=fields)


def arrow_fields(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def apply_rows(df: DataFrame, schema: Schema, phase: str, each: Callable[[Row, Callable[[], Row]], Iterator[Row]], ignore_errors: bool, note: Callable[[str], None] | None = None) -> DataFrame:
    """Run ``each`` on every row; it gets the row and a factory of blank rows and gives rows out.

    The result has the column ERROR: null on good rows, the message on a row that failed, which
    ``note`` gets as well.
    """
    ship(df.sparkSession)
    struct = T.StructType([*schema.struct().fields, T.StructField(ERROR, T.StringType())])
    fields = arrow_fields(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict[str, Any]] = []
            for row in read_rows(batch, schema):
                before = dict(row.values)  # the function may change the row
                try:
                    made = [r.values for r in each(row, lambda: Row(schema, dict.fromkeys(schema.columns)))]
                except Exception as e:
                    text = Row(schema, before).to_string()
                    if not ignore_errors:
                        raise RowError(phase, text, f"{type(e).__name__}: {e}") from e
                    made = [{ERROR: f"{phase} failed on row {text}: {type(e).__name__}: {e}"}]
                    if note is not None:
                        note(made[0][ERROR])
                out += made
            if out:
                yield to_batch(out, schema, fields)

    return df.mapInArrow(run, struct)
