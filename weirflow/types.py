"""Column types: what Spark stores for each and which values fit.

Spark has no unsigned integers, so they are held in the next wider type and checked; Uint64 is a
decimal of 20 digits.  Fixed-width strings and bytes are stored without padding, with their
width as metadata.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from .errors import SchemaError


@dataclass(frozen=True)
class ColumnType:
    """A logical type: name, Spark type, range of integers and width (None: variable)."""

    name: str
    spark: T.DataType
    low: int | None = None
    high: int | None = None
    width: int | None = None
    layout: str | None = None

    def metadata(self) -> dict[str, Any]:
        return {k: v for k, v in (("logical", self.name), ("width", self.width), ("layout", self.layout)) if v is not None}

    def check(self, value: Any) -> Any:
        """The value, if the type can hold it (or None); raises ValueError."""
        if value is None:
            return None
        if self.low is not None:
            if type(value) is int and self.low <= value <= self.high:
                return value
            if isinstance(value, bool) or not isinstance(value, int) and not (hasattr(value, "as_integer_ratio") and value == int(value)):
                raise ValueError(f"{value!r} is no integer for {self.name}")
            if not self.low <= value <= self.high:
                raise ValueError(f"{value} is out of range for {self.name}")
        if self.width is not None and self.name in ("String", "Bytes") and len(value.encode() if isinstance(value, str) else value) > self.width:
            raise ValueError(f"{value!r} is longer than {self.width} bytes")
        return value

    def text(self, value: Any) -> str:
        """A value as text: bytes as hexadecimal digits, times by their layout."""
        if value is None:
            return "nil"
        if isinstance(value, bytes | bytearray):
            return bytes(value).hex()
        if self.layout and isinstance(value, datetime.datetime):
            return value.strftime(strptime_format(self.layout))
        return str(value)


def _integer(name: str, spark: T.DataType, bits: int, signed: bool) -> ColumnType:
    return ColumnType(name, spark, -(1 << bits - 1) if signed else 0, (1 << bits - signed) - 1, bits // 8)


Byte = ColumnType("Byte", T.BinaryType(), width=1)
Bool = ColumnType("Bool", T.BooleanType(), width=1)
Uint8 = _integer("Uint8", T.ShortType(), 8, False)
Uint16 = _integer("Uint16", T.IntegerType(), 16, False)
Uint32 = _integer("Uint32", T.LongType(), 32, False)
Uint64 = _integer("Uint64", T.DecimalType(20, 0), 64, False)
Int8 = _integer("Int8", T.ByteType(), 8, True)
Int16 = _integer("Int16", T.ShortType(), 16, True)
Int32 = _integer("Int32", T.IntegerType(), 32, True)
Int64 = _integer("Int64", T.LongType(), 64, True)
Float32 = ColumnType("Float32", T.FloatType(), width=4)
Float64 = ColumnType("Float64", T.DoubleType(), width=8)
VarString = ColumnType("VarString", T.StringType())
VarBytes = ColumnType("VarBytes", T.BinaryType())


def String(length: int) -> ColumnType:
    return ColumnType("String", T.StringType(), width=length)


def Bytes(length: int) -> ColumnType:
    return ColumnType("Bytes", T.BinaryType(), width=length)


def Time(layout: str) -> ColumnType:
    """A time written by a reference-time layout such as ``2006-01-02 15:04:05``."""
    spark_pattern(layout)
    return ColumnType("Time", T.TimestampNTZType(), width=15, layout=layout)


@dataclass(frozen=True)
class Custom(ColumnType):
    """A variable-length type of the user's: a nested Spark type, or bytes with a codec."""

    encode: Callable[[Any], bytes] | None = None
    decode: Callable[[bytes], Any] | None = None


def custom(name: str, spark: T.DataType) -> Custom:
    return Custom(name, spark)


def coded(name: str, encode: Callable[[Any], bytes], decode: Callable[[bytes], Any]) -> Custom:
    """Any Python value, stored as bytes."""
    return Custom(name, T.BinaryType(), encode=encode, decode=decode)


# Parts of a reference-time layout, with the letters of DateTimeFormatter and of strptime.
LAYOUT_PARTS = (
    ("2006", "yyyy", "%Y"),
    ("01", "MM", "%m"),
    ("02", "dd", "%d"),
    ("15", "HH", "%H"),
    ("03", "hh", "%I"),
    ("04", "mm", "%M"),
    ("05", "ss", "%S"),
    ("PM", "a", "%p"),
    ("Jan", "MMM", "%b"),
    ("Mon", "EEE", "%a"),
    (".000000", ".SSSSSS", ".%f"),
    (".000", ".SSS", ".%f"),
    ("Z07:00", "XXX", "%z"),
    ("MST", "z", "%Z"),
)


def _translate(layout: str, column: int) -> str:
    known = {p[0]: p[column] for p in LAYOUT_PARTS}
    out, at = [], 0
    parts = re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True))))
    for m in parts.finditer(layout):
        out += [_plain(layout[at : m.start()], layout, column), known[m[0]]]
        at = m.end()
    return "".join([*out, _plain(layout[at:], layout, column)])


def _plain(text: str, layout: str, column: int) -> str:
    if re.search(r"[0-9]", text):
        raise SchemaError(f"layout {layout!r}: {text!r} is not supported")
    if column == 2:
        return text.replace("%", "%%")
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text)


def spark_pattern(layout: str) -> str:
    return _translate(layout, 1)


def strptime_format(layout: str) -> str:
    return _translate(layout, 2)
