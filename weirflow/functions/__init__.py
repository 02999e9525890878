"""Accumulators: mergeable folds over all rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..rows import Row
from ..schema import Schema


class Accumulator:
    """Base for accumulators in Python: partial folds on the executors, merged on the driver."""

    def accumulate(self, row: Row) -> None:
        raise NotImplementedError

    def merge(self, other: Accumulator) -> None:
        raise NotImplementedError

    def to_bytes(self) -> bytes:
        return pickle.dumps(self.__dict__)

    def from_bytes(self, data: bytes) -> Accumulator:
        self.__dict__.update(pickle.loads(data))
        return self

    def value(self) -> Any:
        return self

    # An accumulator that aggregate expressions can compute gives them here; the results come back in order.
    def expressions(self, schema: Schema) -> list[Column] | None:
        return None

    def take(self, results: list[Any]) -> None:
        raise NotImplementedError


class Counter(Accumulator):
    """Counts all rows."""

    def __init__(self) -> None:
        self.count = 0

    def accumulate(self, row: Row) -> None:
        self.count += 1

    def merge(self, other: Counter) -> None:
        self.count += other.count

    def expressions(self, schema: Schema) -> list[Column]:
        return [F.count(F.lit(1))]

    def take(self, results: list[Any]) -> None:
        self.count = results[0]

    def value(self) -> int:
        return self.count


NUMBERS = ("ByteType", "ShortType", "IntegerType", "LongType", "FloatType", "DoubleType", "DecimalType")


class Adder(Accumulator):
    """Sums a numeric column as a double; a column of another type adds nothing."""

    def __init__(self, column: str) -> None:
        self.column, self.sum = column, 0.0

    def accumulate(self, row: Row) -> None:
        value = row.values[self.column]
        if value is not None and not isinstance(value, bool | str | bytes):
            self.sum += float(value)

    def merge(self, other: Adder) -> None:
        self.sum += other.sum

    def expressions(self, schema: Schema) -> list[Column]:
        if not schema.has_column(self.column):
            raise SchemaError(f"column {self.column} does not exist")
        if type(schema.get_column(self.column).spark).__name__ not in NUMBERS:
            return [F.lit(0.0)]
        return [F.coalesce(F.sum(F.col(f"`{self.column}`").cast("double")), F.lit(0.0))]

    def take(self, results: list[Any]) -> None:
        self.sum = results[0]

    def value(self) -> float:
        return self.sum


class Composed(Accumulator):
    """Several accumulators in one pass; the results stand in their order."""

    def __init__(self, factories: Iterable[Callable[[], Accumulator]]) -> None:
        self.parts = [f() for f in factories]

    def accumulate(self, row: Row) -> None:
        for p in self.parts:
            p.accumulate(row)

    def merge(self, other: Composed) -> None:
        for p, q in zip(self.parts, other.parts, strict=True):
            p.merge(q)

    def to_bytes(self) -> bytes:
        return pickle.dumps([p.to_bytes() for p in self.parts])

    def from_bytes(self, data: bytes) -> Composed:
        self.parts = [p.from_bytes(b) for p, b in zip(self.parts, pickle.loads(data), strict=True)]
        return self

    def expressions(self, schema: Schema) -> list[Column] | None:
        each = [p.expressions(schema) for p in self.parts]
        return None if any(e is None for e in each) else [c for e in each for c in e]

    def take(self, results: list[Any]) -> None:
        for p in self.parts:
            p.take(results[:1] if not isinstance(p, Composed) else results[: p.width()])
            results = results[1 if not isinstance(p, Composed) else p.width() :]

    def width(self) -> int:
        return sum(p.width() if isinstance(p, Composed) else 1 for p in self.parts)

    def value(self) -> list[Any]:
        return [p.value() for p in self.parts]


def adder(column: str) -> Callable[[], Adder]:
    return lambda: Adder(column)


def compose(*factories: Callable[[], Accumulator]) -> Callable[[], Composed]:
    return lambda: Composed(factories)
