"""Errors that users of the package can meet."""

from __future__ import annotations


class NilValueError(ValueError):
    """A getter was used on a missing value."""

    def __init__(self, column: str):
        super().__init__(f"column {column} has no value")
        self.column = column


class SchemaError(ValueError):
    """A column is missing, doubled or of a wrong type."""


class RowError(RuntimeError):
    """A row function failed on a row: the phase, the row's text and the cause."""

    def __init__(self, phase: str, row: str, cause: str):
        super().__init__(f"{phase} failed on row {row}: {cause}")
        self.phase, self.row, self.cause = phase, row, cause


class ParseError(ValueError):
    """A line or cell can't be read as its column's type."""


class RunTimeout(TimeoutError):
    """A run was stopped at its time limit."""


class StreamTimeout(TimeoutError):
    """A stream was stopped at its time limit."""
