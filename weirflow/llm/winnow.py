"""Document fingerprints by winnowing.

Every k-gram of code points gets a 64-bit hash, put together from those of its halves.  Of each
window of ``WINDOW`` adjacent hashes the least by its first 48 bits is chosen, the rightmost one
of equals, and kept whole with its position.  So any passage of at least ``K + WINDOW - 1`` code
points that two texts share gives a common fingerprint, and positions tell where it lies.  Texts
of any length are hashed in pieces that overlap by a window.

``in_descending_ranges`` brings every document together with the one that follows in descending order of
id: documents go to ranges of ids, each range is sorted, and the first document of each range is
also sent to the range before it.  One shuffle of the texts, no global window.  An id with more
rows than a range, and null, has several ranges, by a hash of the text; only rows equal in id
and text stay together.

Defined results: a null text is empty and has an empty fingerprint; a text shorter than K has
one hash, that of the whole text.  Two empty fingerprints are alike (1), one empty is not (0).
Rows are in descending order of doc_id, null ids last, rows of one id by a hash of the text,
then text; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._common import OUT_ROWS, arrow_type, as_batch

K = 16
WINDOW = 32
#: Hashes that are looked at together: their places fit the bits of a hash that do not order it.
PIECE = 1 << 16
MULTIPLIER = 0x9E3779B97F4A7C15
MIXER = 0xBF58476D1CE4E5B9


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, by position."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(text))
    grams = len(text) - k + 1
    width = min(window, grams)
    hashes, positions, last = [], [], -1
    step = PIECE - width + 1  # windows of a piece
    for start in range(0, grams - width + 1, step):
        stop = min(start + PIECE, grams)
        h, at = _piece(text[start : stop + k - 1], k, width)
        at += start
        if at[0] == last:  # chosen by the last window of the piece before
            h, at = h[1:], at[1:]
        last = at[-1] if len(at) else last
        hashes.append(h)
        positions.append(at)
    return np.concatenate(hashes), np.concatenate(positions)


def _piece(text: str, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``winnow`` of at most PIECE k-grams."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = _grams(points, k)
    h ^= h >> np.uint64(30)
    h *= np.uint64(MIXER)
    h ^= h >> np.uint64(27)
    # the hash's first bits above, place from the right below: the least is the least hash, rightmost of equals
    span = np.uint64(PIECE - 1)
    least, size = (h & ~span) | (span - np.arange(len(h), dtype=np.uint64)), 1
    while size < width:  # windows of a power of two, then two overlapping ones
        step = min(size, width - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    at = (span - (least[np.r_[True, least[1:] != least[:-1]]] & span)).astype(np.int64)
    return h[at], at


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, put together from grams of half the size."""
    if k == 1:
        return points * np.uint64(MULTIPLIER) + np.uint64(1)
    half = k // 2
    left = _grams(points, half)
    right = left if k % 2 == 0 else _grams(points, k - half)
    power = np.uint64(pow(MULTIPLIER | 1, k - half, 1 << 64))
    count = len(points) - k + 1
    return left[:count] * power + right[half : half + count]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the common hashes by the number of both texts' distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The fingerprint as text: hash (hexadecimal) and position of each choice."""
    return " ".join(f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True))


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much (or all) of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_descending_ranges(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, part, lead): each document in its range of ids, and with ``lead`` the first
    documents of the next range once more at the end of each.

    The limits of the ranges are approximate quantiles of the ids, several for each shuffle
    partition so that these come out even; an id that is several quantiles, or null, has as many
    ranges by a hash of the text.  Limits and each range's first id and hash reach the driver, a
    few for each shuffle partition, and go to the tasks, where a range is found by binary search.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts)).alias("limits"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    limits, rows = np.unique(np.array(found.limits or [], dtype=np.int64), return_counts=True) if parts > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    common = set(limits[rows > 1].tolist())
    # a common id has its ranges to itself: the limit before it is the next smaller id
    limits = np.array(sorted({*limits.tolist(), *(i - 1 for i in common if i > -(1 << 63))}), dtype=np.int64)
    times = dict(zip(*np.unique(np.array(found.limits or [], dtype=np.int64), return_counts=True), strict=True))
    nulls = max(1, (found.n - found.known) * parts // max(1, found.n))
    # ranges in order: the largest ids (no limit above them), ..., the smallest, null
    split = np.array([1, *(times[i] if i in common else 1 for i in limits[::-1].tolist()), nulls], dtype=np.int64)
    base, hashed = np.cumsum(split) - split, bool((split > 1).any())

    def ranges(values: pa.Array, marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(range, id, hash) of each row."""
        known = values.fill_null(0).to_numpy(zero_copy_only=False)
        mark = marks.to_numpy(zero_copy_only=False)
        at = np.where(values.is_null().to_numpy(zero_copy_only=False), len(limits) + 1, len(limits) - np.searchsorted(limits, known, side="left"))
        share = ((mark.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64)
        return (base[at] + (share * split[at] >> 32)).astype(np.int32), known, mark

    @F.arrow_udf("int")
    def range_of(values: pa.Array, marks: pa.Array) -> pa.Array:
        return pa.array(ranges(values, marks)[0])

    mark = F.xxhash64(F.coalesce("text", F.lit(""))) if hashed else F.lit(0).cast("long")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), mark.alias("mark"))
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "mark")).alias("first")
    firsts = {r.part: r.first for r in marked.groupBy(range_of("doc_id", "mark").alias("part")).agg(first).collect()}
    order = sorted(firsts)
    # where a range's first documents are needed again: in the range before, those of the first in the last
    size = int(split.sum())
    again, head, head_mark = np.full(size, -1, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i, p in enumerate(order):
        again[p], head[p], head_mark[p] = order[i - 1], ~(firsts[p].down if firsts[p].down is not None else -1), firsts[p].mark

    @F.arrow_udf("int")
    def needed_in(values: pa.Array, marks: pa.Array) -> pa.Array:
        """The range in which a document is needed again, -1 for most."""
        at, known, mark = ranges(values, marks)
        return pa.array(np.where((known == head[at]) & (mark == head_mark[at]), again[at], -1).astype(np.int32))

    row = marked.select("doc_id", "text", range_of("doc_id", "mark").alias("own"), needed_in("doc_id", "mark").alias("again"))
    places = F.filter(F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("lead")), F.struct(F.col("again").alias("part"), F.lit(1).alias("lead"))), lambda x: x["part"] >= 0)
    placed = row.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.part", "at.lead")
    return placed.repartition("part").sortWithinPartitions("part", "lead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next.  At most one row of look-ahead is held besides a batch.
    """
    ship(docs.sparkSession)
    schema = T._parse_datatype_string("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    fields = arrow_type(schema)

    def row(doc_id, text: str, own, following: str, other) -> tuple:
        new = edited(text, following)
        changed = winnow(new)
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(*own), written(*changed), likeness(own[0], changed[0]), likeness(own[0], other[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = None  # the row whose next document isn't known yet: part, id, text, fingerprint
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                for doc_id, text, part, lead in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                    own = winnow(text)
                    if waiting and waiting[0] == part:
                        held.append(row(*waiting[1:], text, own))
                    # only the first of a part's leads is needed, and it has no row of its own
                    waiting = None if lead else (part, doc_id, text, own)
                    if len(held) >= OUT_ROWS // 4:
                        yield as_batch(held, fields)
                        held = []
        if held:
            yield as_batch(held, fields)

    return in_descending_ranges(docs).mapInArrow(run, schema)
