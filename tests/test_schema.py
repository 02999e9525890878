import datetime

import pytest

from weirflow import types as t
from weirflow.errors import NilValueError, SchemaError
from weirflow.rows import Row
from weirflow.schema import Schema, create_schema


def sample() -> Schema:
    return create_schema(a=t.Uint64, b=t.VarString, c=t.String(12), d=t.Int8)


def test_equality_depends_on_order_and_width():
    assert sample().equals(sample())
    assert not sample().equals(create_schema(b=t.VarString, a=t.Uint64, c=t.String(12), d=t.Int8))
    assert not sample().equals(create_schema(a=t.Uint64, b=t.VarString, c=t.String(13), d=t.Int8))


def test_columns_change_by_operations_only():
    s = sample()
    with pytest.raises(SchemaError):
        s.create_column("a", t.Int8)
    with pytest.raises(SchemaError):
        s.rename_column("missing", "x")
    with pytest.raises(SchemaError):
        s.rename_column("a", "b")
    s.rename_column("a", "z").remove_column("c")
    assert s.column_names == ["z", "b", "c", "d"]
    assert s.is_marked_for_removal("c") and s.has_column("c") and s.num_removed_columns == 1
    with pytest.raises(SchemaError):
        s.remove_column("c")
    assert s.repack().column_names == ["z", "b", "d"]
    assert (s.num_columns, s.num_fixed_length_columns, s.num_variable_length_columns) == (4, 3, 1)


def test_widths():
    assert create_schema(a=t.Uint64).row_width == 8
    assert create_schema(a=t.Uint64).size == 16
    assert create_schema(a=t.Bytes(65)).size == 128


@pytest.mark.parametrize(("kind", "good", "bad"), [(t.Uint8, 255, 256), (t.Int8, -128, -129), (t.Uint64, 2**64 - 1, 2**64), (t.Uint16, 65535, -1), (t.Int64, 2**63 - 1, 2**63), (t.String(3), "abc", "abcd"), (t.Bytes(2), b"ab", b"abc")])
def test_values_are_checked(kind, good, bad):
    assert kind.check(good) == good and kind.check(None) is None
    with pytest.raises(ValueError):
        kind.check(bad)


def test_row_accessors():
    row = Row(sample(), {"a": 5, "b": None, "c": "x", "d": -1})
    assert row.get_uint64("a") == 5 and row.is_nil("b")
    with pytest.raises(NilValueError):
        row.get_var_string("b")
    with pytest.raises(SchemaError):
        row.get_int32("a")
    row.set_int8("d", 7)
    with pytest.raises(ValueError):
        row.set_int8("d", 300)
    row.set_nil("c")
    assert row.to_string() == "{a: 5, b: nil, c: nil, d: 7}"


def test_layouts():
    assert t.spark_pattern("2006-01-02 15:04:05") == "yyyy-MM-dd HH:mm:ss"
    assert t.spark_pattern("2006-01-02T15:04:05.000Z07:00") == "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
    assert t.Time("2006-01-02").text(datetime.datetime(2020, 2, 3)) == "2020-02-03"
    with pytest.raises(SchemaError):
        t.Time("2007-01-02")
