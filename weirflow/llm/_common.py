"""Shared helpers: the cluster's shared folder, Arrow mapping and the common word rule."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shared_root, ship

#: White space that parts words: space and \t \n \v \f \r.  ``bytes.split()`` uses the same set.
SPACES = " \t\n\x0b\x0c\r"
#: One word, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that the Python side of an operator returns in one Arrow batch.
OUT_ROWS = 2048


#: The innermost open block's tables; ``written`` adds to it.
_made: ContextVar[list[Table] | None] = ContextVar("made", default=None)


@dataclass(eq=False)
class Table:
    """A table in the shared folder and the frame that reads it."""

    frame: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files; no later plan may read them."""
        place = self.frame.sparkSession._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.frame.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str) -> Table:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage.

    The files survive the loss of any executor.  Within ``scratch`` they go at the block's end.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/weirflow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = Table(spark.read.schema(df.schema).parquet(path), path)
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame of ``written``."""
    return written(df, label).frame


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Delete the tables written within the block when it ends, however it ends.

    The block gets a function that excepts the tables that its result still reads; they belong to
    the block around it, if there is one.
    """
    outer, made, kept = _made.get(), [], []
    token = _made.set(made)
    try:
        yield lambda *tables: kept.extend(tables)
    except BaseException:
        kept.clear()
        raise
    finally:
        _made.reset(token)
        for t in made:
            if t not in kept:
                t.drop()
            elif outer is not None:
                outer.append(t)


def arrow_type(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], Iterator[tuple]]], schema: str, by_batch: bool = False) -> DataFrame:
    """``mapInArrow`` with Python values: ``make()`` runs once per task and returns a function
    from a batch (column name to list) to an iterator of output tuples.

    At most OUT_ROWS output rows are held at a time; ``by_batch``, none beyond the end of an
    input batch, whose bytes bound theirs.
    """
    ship(df.sparkSession)
    out = T._parse_datatype_string(schema)
    fields = arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        held: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                for row in rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}):
                    held.append(row)
                    if len(held) >= OUT_ROWS:
                        yield as_batch(held, fields)
                        held = []
            if by_batch and held:
                yield as_batch(held, fields)
                held = []
        if held:
            yield as_batch(held, fields)

    return df.mapInArrow(run, out)


def as_batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Generations(dict):
    """A memo in two generations of at most ``bound`` entries each; ``make`` gives what is in neither.

    A full one becomes the old one; what is found there again moves to the new one.  So frequent
    entries stay while rare ones go.
    """

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.old = bound, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` rows (doc_id, text, label): labelled documents, one row for each id.

    The rows of ``labels`` with the least hash of their id are taken, and of an id's documents the
    one whose text has the least hash, so the choice does not depend on how the tables are stored.
    The chosen ids are ``limit`` rows of two numbers, which bounds what is broadcast.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
