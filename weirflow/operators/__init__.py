"""The operations of a pipeline.

Each has two tiers: with Column expressions Catalyst sees the whole plan; with Python row
functions the rows pass through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..schema import Schema
from ..types import ColumnType


def col(name: str) -> Column:
    """A flat column by its literal name; dots are part of it."""
    return F.col(f"`{name}`")


class Operation:
    """Base of all operations.  ``shuffles`` ends a stage, ``ends`` the pipeline."""

    shuffles = False
    ends = False


@dataclass(frozen=True)
class AddColumn(Operation):
    """An empty column, visible in its whole stage."""

    name: str
    kind: ColumnType


@dataclass(frozen=True, init=False)
class RemoveColumn(Operation):
    """Columns that go at the end of the stage; later operations of the stage still see them."""

    names: tuple[str, ...]

    def __init__(self, *names: str):
        object.__setattr__(self, "names", names)


@dataclass(frozen=True)
class RenameColumn(Operation):
    old: str
    new: str


@dataclass(frozen=True)
class Map(Operation):
    """Change rows one to one: a mapping of columns to expressions, or a function of the row."""

    what: dict[str, Column] | Callable[[Any], None]


@dataclass(frozen=True)
class FlatMap(Operation):
    """Each row to any number of rows.

    An expression: an array of structs (or of values, with ``into``), whose fields become the row
    while all other columns are blank; ``keep`` names columns that keep their values.  A
    function: of the row and a factory of blank rows; rows made by the factory are given out.
    """

    what: Column | Callable[[Any, Callable[[], Any]], None]
    into: str | None = None
    keep: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter(Operation):
    """Keep the rows for which a condition holds (an expression or a function of the row)."""

    what: Column | Callable[[Any], bool]


Key = Sequence[str] | Column | Callable[[Any], bytes]


def key_columns(*names: str) -> tuple[str, ...]:
    """A key of columns, in this order."""
    return names


@dataclass(frozen=True)
class Group(Operation):
    """Bring rows of one key together in one partition, next to each other."""

    key: Key
    size: int | None = None
    shuffles = True


@dataclass(frozen=True)
class Reduce(Operation):
    """One row per key.

    ``merge``: aggregate expressions by column (all other columns keep the value of some row), or
    a function (left, right) that changes left; it must be associative and commutative and is
    not called for a key with one row.
    """

    key: Key
    merge: dict[str, Column] | Callable[[Any, Any], None]
    size: int | None = None
    shuffles = True


def Repartition(size: int, key: Key) -> Group:
    """Group, and deal the rows of a key in chunks of ``size`` rows, the last one smaller.

    ``Collect`` then brings chunks and ``Pipeline.chunked`` numbers them.
    """
    return Group(key, size)


def RepartitionReduce(size: int, key: Key, merge: dict[str, Column] | Callable[[Any, Any], None]) -> Reduce:
    """Reduce, and deal the results in chunks of ``size`` rows, the last one smaller."""
    return Reduce(key, merge, size)


@dataclass(frozen=True)
class Collect(Operation):
    """Bring at most ``partitions`` chunks of rows to the caller, any ones, in any order.

    Chunks are those of a repartitioning just before; else any rows, as many as the partition size says.
    """

    partitions: int
    ends = True


@dataclass(frozen=True)
class Accumulate(Operation):
    """Fold all rows into an accumulator."""

    factory: Callable[[], Any]
    ends = True


@dataclass(frozen=True)
class ForEach(Operation):
    """Run a function on every row for its effect."""

    do: Callable[[Any], None]
    ends = True


@dataclass(frozen=True)
class Custom(Operation):
    """An operation of the user's: (frame, schema) to (frame, schema)."""

    do: Callable[[DataFrame, Schema], tuple[DataFrame, Schema]]
    shuffles: bool = field(default=False)


def check(op: Operation, schema: Schema) -> Schema:
    """The schema after an operation, which must fit; removal is only marked."""
    out = schema.clone()
    if isinstance(op, AddColumn):
        out.create_column(op.name, op.kind)
    elif isinstance(op, RemoveColumn):
        for n in op.names:
            out.remove_column(n)
    elif isinstance(op, RenameColumn):
        out.rename_column(op.old, op.new)
    elif isinstance(op, Map) and isinstance(op.what, dict):
        _known(op.what, out)
    elif isinstance(op, Group | Reduce):
        if isinstance(op.key, Sequence):
            _known(op.key, out)
        if isinstance(op, Reduce) and isinstance(op.merge, dict):
            _known(op.merge, out)
    return out


def _known(names, schema: Schema) -> None:
    for n in names:
        if n not in schema.columns:
            raise SchemaError(f"column {n} does not exist")
