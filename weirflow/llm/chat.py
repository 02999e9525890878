"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only
its reply is trained on.  Turns after the last reply, or a conversation without one, make a last
example without a trained part, so no turn is lost.  A turn is written as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

and ``<|`` inside a text gets a backslash between its two characters (one more, if there are
some), which is undone on reading.

Rows are dealt by conversation and sorted by turn.  A task makes the examples of up to ``TURNS``
turns; a longer conversation goes to several tasks, each with all of its turns, so that its
examples, whose size grows with the square of its turns, are not made in one.  A task holds
one conversation's turns and about one batch of examples.  Reading examples back is spread like
making them; one task then only puts a conversation's digests and trained texts in order.

Defined results: null texts and roles are empty; rows with a null conversation make up one; rows
of one turn are in the order of role and text, null turns first; repeated rows are turns of
their own; texts may have any length; an empty table gives an empty result; columns other than
the four are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._common import arrow_type, as_batch

START, END = "<|im_start|>", "<|im_end|>"
OPENER = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
TARGET = "assistant"
#: Characters that a batch of examples holds, about.
BATCH_CHARS = 4_000_000
#: Turns whose examples one task makes.
TURNS = 512


@dataclass
class Example:
    """A formatted example and the part of it, by code points, that is trained on (empty: none)."""

    text: str
    loss_start: int
    loss_end: int


def escape(text: str) -> str:
    return OPENER.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def numbered(turns: Iterable[tuple[str, str]], first: int = 0, stop: int | None = None) -> Iterator[tuple[int, Example]]:
    """The examples of one conversation that end with its turns from ``first`` up to ``stop``, with their numbers."""
    context: list[str] = []
    size, number, at, open_turns = 0, 0, -1, True
    for at, (role, text) in enumerate(turns):
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        context.append(f"{head}{body}{END}\n")
        if not (open_turns := role != TARGET):
            if first <= at and (stop is None or at < stop):
                yield number, Example("".join(context), size + len(head), size + len(head) + len(body))
            number += 1
        size += len(context[-1])
    if open_turns and first <= at and (stop is None or at < stop):
        yield number, Example("".join(context), 0, 0)


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[Example]:
    """The examples of one conversation, from its turns (role, text) in order."""
    return (e for _, e in numbered(turns))


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted example."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def _conversations(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int | None, int], list[tuple[str, str]]]]:
    """((conversation, part), turns) from batches (conv_id, part, role, text) in order."""
    each = ((row[:2], (row[2] or "", row[3] or "")) for batch in rows for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
    for key, group in groupby(each, key=lambda r: r[0]):
        yield key, [turn for _, turn in group]


def _ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, role, text): a conversation's turns in order, once for each part of its examples."""
    ship(conversations.sparkSession)
    picked = conversations.select("conv_id", "role", "text", "turn")
    sizes = picked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TURNS)
    parts = sizes.select(F.col("conv_id").alias("_conv"), F.ceil(F.col("_n") / TURNS).cast("int").alias("_parts"))
    met = picked.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    spread = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return spread.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text").select("conv_id", "part", "role", "text")


def _batches(rows: Iterator[tuple], size_of: Callable[[tuple], int], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_CHARS."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + size_of(row)
        if size >= BATCH_CHARS:
            yield as_batch(held, fields)
            held, size = [], 0
    if held:
        yield as_batch(held, fields)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The examples: conv_id, example (from 0), text, loss_start, loss_end."""
    schema = T._parse_datatype_string("conv_id long, example long, text string, loss_start long, loss_end long")
    fields, most = arrow_type(schema), TURNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((conv, i, e.text, e.loss_start, e.loss_end) for (conv, part), turns in _conversations(batches) for i, e in numbered(turns, part * most, (part + 1) * most))
        yield from _batches(made, lambda r: len(r[2]), fields)

    return _ordered(conversations).mapInArrow(run, schema)


def read_back(e: Example) -> tuple[int, str, str | None, str, int]:
    """Of one example: the number of its turns, their digest, that of those up to the last target before
    its last turn (none: null), the trained text, and the example's length."""
    turns, digest, before = parse(e.text), hashlib.sha256(), None
    for i, (role, text) in enumerate(turns):
        digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == TARGET and i < len(turns) - 1:
            before = digest.copy()
    return len(turns), digest.hexdigest(), before and before.hexdigest(), unescape(e.text[e.loss_start : e.loss_end]), len(e.text)


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the rows of ``format_conversations`` hold, by conversation, read back from them.

    Every example must begin with all turns of the one before; else the run ends.
    """
    ship(examples.sparkSession)
    read = T._parse_datatype_string("conv_id long, example long, n_turns long, digest string, before string, trained string, chars long")
    schema = T._parse_datatype_string("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    read_fields, fields = arrow_type(read), arrow_type(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([batch.column(k)[i].as_py() for k in range(5)] for batch in batches for i in range(batch.num_rows))  # one example at a time
        yield from _batches(((conv, i, *read_back(Example(*e))) for conv, i, *e in rows), lambda r: len(r[5]), read_fields)

    def whole(rows: Iterator[tuple]) -> tuple:
        loss, loss_chars, chars, last, n = hashlib.sha256(), 0, 0, None, 0
        for i, (_, example, n, digest, before, trained, size) in enumerate(rows):
            if example != i or before != last:
                raise ValueError(f"example {i} does not begin with the turns of the one before")
            loss.update(trained.encode("utf-8", "surrogatepass"))
            loss_chars, chars, last = loss_chars + len(trained), chars + size, digest
        return n, last, loss_chars, loss.hexdigest(), chars

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True))
        yield from _batches(((conv, *whole(group)) for conv, group in groupby(rows, key=lambda r: r[0])), lambda r: 200, fields)

    found = examples.select("conv_id", "example", "text", "loss_start", "loss_end").mapInArrow(each, read)
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(join, schema)


def digest_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of the formatted examples of every conversation."""
    return digest_examples(format_conversations(conversations))


def with_escape_case(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold the template's own control strings."""
    spark = conversations.sparkSession
    text = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
