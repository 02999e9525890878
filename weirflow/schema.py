"""Schemas: named, typed columns in order, changed by operations and never inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import SchemaError
from .types import ColumnType


@dataclass
class Schema:
    """Columns by name, in order, and those marked for removal at the end of the stage."""

    columns: dict[str, ColumnType] = field(default_factory=dict)
    removed: set[str] = field(default_factory=set)

    def create_column(self, name: str, kind: ColumnType) -> Schema:
        if name in self.columns:
            raise SchemaError(f"column {name} exists already")
        self.columns[name] = kind
        return self

    def rename_column(self, old: str, new: str) -> Schema:
        self._present(old)
        if new in self.columns:
            raise SchemaError(f"column {new} exists already")
        self.columns = {new if n == old else n: k for n, k in self.columns.items()}
        return self

    def remove_column(self, name: str) -> Schema:
        self._present(name)
        self.removed.add(name)
        return self

    def repack(self) -> Schema:
        """A schema without the columns that are marked for removal."""
        return Schema({n: k for n, k in self.columns.items() if n not in self.removed})

    def clone(self) -> Schema:
        return Schema(dict(self.columns), set(self.removed))

    def equals(self, other: Schema) -> bool:
        """The same columns of the same types and widths in the same order."""
        return list(self.columns.items()) == list(other.columns.items())

    def _present(self, name: str) -> None:
        if name not in self.columns or name in self.removed:
            raise SchemaError(f"column {name} does not exist")

    def has_column(self, name: str) -> bool:
        return name in self.columns

    def is_marked_for_removal(self, name: str) -> bool:
        return name in self.removed

    def get_column(self, name: str) -> ColumnType:
        if name not in self.columns:
            raise SchemaError(f"column {name} does not exist")
        return self.columns[name]

    @property
    def column_names(self) -> list[str]:
        return list(self.columns)

    @property
    def column_types(self) -> list[ColumnType]:
        return list(self.columns.values())

    def for_each_column(self, do: Callable[[str, ColumnType], None]) -> None:
        for n, k in self.columns.items():
            do(n, k)

    def __iter__(self) -> Iterator[tuple[str, ColumnType]]:
        return iter(self.columns.items())

    @property
    def num_columns(self) -> int:
        return len(self.columns)

    @property
    def num_fixed_length_columns(self) -> int:
        return sum(k.width is not None for k in self.columns.values())

    @property
    def num_variable_length_columns(self) -> int:
        return sum(k.width is None for k in self.columns.values())

    @property
    def num_removed_columns(self) -> int:
        return len(self.removed)

    @property
    def row_width(self) -> int:
        """Bytes of the fixed-width columns."""
        return sum(k.width or 0 for k in self.columns.values())

    @property
    def size(self) -> int:
        """The row width padded to 16, 32, 64 or a multiple of 64 bytes."""
        w = self.row_width
        return next((s for s in (16, 32) if w <= s), -(-w // 64) * 64)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, k.spark, True, k.metadata()) for n, k in self.columns.items()])


def create_schema(**columns: ColumnType) -> Schema:
    return Schema(dict(columns))


def schema_of(frame_schema: T.StructType) -> Schema:
    """The schema of an existing DataFrame: each Spark type as a type of its own."""
    return Schema({f.name: ColumnType(f.metadata.get("logical", f.dataType.typeName()), f.dataType, width=f.metadata.get("width"), layout=f.metadata.get("layout")) for f in frame_schema})
