"""N-gram Jaccard join: prefix filtering with rare n-grams first.

Every document is the set of its distinct five-word shingles (64-bit hashes; lower-cased A-Z).
Documents with equal sets are one class.  Two classes are linked if their Jaccard similarity is
``PERCENT`` percent or more.  The join works on classes:

1. shingles below a hash limit (half as many again as a prefix needs) are dealt out by hash
   and counted over all documents; those that one document has go no further, the others come
   back with their frequency: the rarest first, in one order for all documents;
2. two linked sets must share one of their first n - ceil(PERCENT n / 100) + 1 shingles: only
   these prefixes are dealt out, by shingle, and only shingles of several classes go on;
3. within a shingle's classes, in order of size, the length and positional filters prune pairs;
4. pairs are made distinct, pruned by the suffix filter (the sets' counts in ranges of hashes
   bound their overlap) and verified once on the whole sets;
5. linked classes are joined to components by propagating the least label.

Copies and near copies must not cost the square of their number, and no link may be lost.  So
pairs are taken in rounds: first each class with its neighbours in its shingles' lists; then all
pairs that still lie in different components.  A pair within a component
can't change it.  Long lists are cut into blocks of which every two meet in one task.

Defined results: null or blank texts have an empty set and are linked with nothing; with fewer
than five words the whole sequence is the one shingle; rows with equal texts are in one class,
whatever their ids; component_id is the least non-null id reachable, null if there is none; a
text of any length is one set; an empty table gives an empty result; columns other than doc_id
and text are not read, so extra ones may have any name.  Tasks are run again where executors are
lost, so ``docs`` must give the same rows in the same order again, as files do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._common import Table, arrow_type, scratch, stored, written
from ._shingles import column_sets, mixed
from .components import least_labels

PERCENT = 80
#: Shingles with a hash below this are counted: three tenths of them; a prefix has two tenths.
COUNTED = np.uint64((1 << 64) // 10 * 3)
#: Ranges of hashes in a set's profile, for the suffix filter; two to a byte, counts modulo 16.
PROFILE = 256
#: Classes of one shingle that a task pairs with each other; longer lists are cut.
BLOCK = 512
#: Classes before it in a shingle's list that a class is paired with in the first round.
NEAR = 6
#: Lists of more classes apply the suffix filter to their pairs at once.
SHORT = 16
#: Partners of one class that are verified together with one copy of its text.
PARTNERS = 64
#: Bits of the filter that spares texts which no pair needs: for each wanted text, and at most.
#: Beyond that more texts go to the join that decides.
BLOOM_SHARE, BLOOM_MOST = 16, 1 << 28
#: Shingles and documents that a task gathers before it deals them out.
HELD, HELD_DOCS = 1 << 20, 60_000
#: Documents of those gathered that a shingle's entry names; a more common one's stay behind.
COMMON = 64
#: Classes that a task remembers to have given out.
MEMO = 400_000
#: Bytes of rows that a task puts into one batch.
BATCH = 4 << 20


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _texts(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*(part.column(i).to_pylist() for i in columns), strict=True)


class _Rows:
    """Gathers rows into batches of about BATCH bytes."""

    def __init__(self, fields: pa.Schema):
        self.fields, self.held, self.size = fields, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if self.size > BATCH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = zip(*self.held, strict=True)
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.fields, strict=True)], schema=self.fields)


def prefix_length(n):
    """Shingles of a set of ``n``, the rarest, of which linked sets share one."""
    return n + PERCENT * -n // 100 + 1


def _profile(s: np.ndarray) -> bytes:
    """Set members in each of PROFILE ranges of hashes, modulo 16."""
    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PROFILE).astype(np.uint8) & 15
    return (counts[0::2] | (counts[1::2] << 4)).tobytes()


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Members in which sets with these profiles differ at least: differences modulo 16 are no
    larger than the true ones."""
    low, high = (x - y) & 15, ((x >> 4) - (y >> 4)) & 15
    return (np.minimum(low, 16 - low) + np.minimum(high, 16 - high)).sum(axis=-1, dtype=np.int64)


#: A document as it travels with those gathered together; counted: -1 where its class was given out before.
DOC = np.dtype([("id", "<i8"), ("null", "?"), ("key", "<i8"), ("node", "<i8"), ("n", "<i8"), ("counted", "<i8")])
#: Of those gathered together: a part of their shingles, by hash (32 bits within the part), in how
#: many of them each is and in which.  Or, with ``docs``, the documents themselves and COMMON shingles.
PACK = "part int, gathered long, token binary, docs_of binary, places binary, docs binary, profiles binary"
COUNTED_PACK = f"{PACK}, frequency binary"
SETS = "doc_id long, key long, node long, n_shingles long, profile binary, token long, pos int"


class _Gatherer:
    """The shingles of a task's documents, given out as rows of PACK."""

    def __init__(self, parts: int, task: int, fields: pa.Schema):
        self.parts, self.number, self.seen, self.rows = parts, task << 32, set(), _Rows(fields)
        self._clear()

    def _clear(self) -> None:
        self.docs, self.profiles, self.sent, self.at, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, key: int, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, node, counted = len(s), _node(s), -1
        if n and node not in self.seen:
            if len(self.seen) > MEMO:
                self.seen.clear()
            self.seen.add(node)
            counted = int(np.searchsorted(s, COUNTED))
            # a set with too few counted shingles goes on with the next ones by hash
            self.sent.append(s[: max(counted, prefix_length(n))])
            self.at.append(len(self.docs))
            self.profiles.append(_profile(s))
            self.size += len(self.sent[-1])
        self.docs.append((doc_id or 0, doc_id is None, key, node, n, counted))
        if self.size > HELD or len(self.docs) >= HELD_DOCS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        s = np.concatenate([np.zeros(0, np.uint64), *self.sent])
        place = np.repeat(np.array(self.at, np.uint16), [len(x) for x in self.sent])
        high = s >> np.uint64(32)
        part = np.where(s < COUNTED, high * np.uint64(self.parts) // np.uint64((int(COUNTED) >> 32) + 1), np.uint64(self.parts) + high % np.uint64(self.parts))
        token = (part << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))
        order = np.argsort(token, kind="stable")
        token, place = token[order], place[order]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        times = np.diff(np.r_[starts, len(token)]).astype(np.uint32)
        token, common = token[starts], times > COMMON
        named = np.repeat(~common, times)
        upto = np.r_[0, np.cumsum(np.where(common, 0, times))]
        places = place[named]
        edges = np.searchsorted(token, np.arange(2 * self.parts + 1, dtype=np.uint64) << np.uint64(32))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[p], edges[p + 1]
            yield from self.rows.add(p, self.number, token[a:b].astype(np.uint32).tobytes(), times[a:b].tobytes(), places[upto[a] : upto[b]].tobytes(), None, None)
        docs = np.array(self.docs, DOC).tobytes()
        yield from self.rows.add(xxhash.xxh32_intdigest(str(self.number)) % (2 * self.parts), self.number, token[common].tobytes(), times[common].tobytes(), place[~named].tobytes(), docs, b"".join(self.profiles))
        yield from self.rows.rest()
        self.number += 1
        self._clear()


def _counted(packs: list[tuple]) -> Iterator[tuple]:
    """Of a part's packs, the shingles that are in several documents, with their frequency."""
    token = [np.frombuffer(p[2], np.uint32) for p in packs]
    times = [np.frombuffer(p[3], np.uint32) for p in packs]
    every = np.concatenate(token)
    order = np.argsort(every, kind="stable")
    starts = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
    total = np.add.reduceat(np.concatenate(times).astype(np.int64)[order], starts)
    frequency = np.empty(len(every), np.int64)
    frequency[order] = np.repeat(total, np.diff(np.r_[starts, len(every)]))
    at = 0
    for pack, t, n in zip(packs, token, times, strict=True):
        f = frequency[at : at + len(t)]
        at += len(t)
        kept = f > 1
        if kept.any():
            places = np.frombuffer(pack[4], np.uint16)[np.repeat(kept, np.where(n > COMMON, 0, n))]
            yield *pack[:2], t[kept].tobytes(), n[kept].tobytes(), places.tobytes(), None, None, np.minimum(f[kept], 0xFFFFFFFF).astype(np.uint32).tobytes()


def _prefixes(packs: list[tuple], parts: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(documents, (place, token, position)) of documents gathered together: their prefix shingles
    that several documents have.

    The order of a set's shingles: the counted ones by frequency, then token; then the others.
    What one document alone has comes first and only shifts positions.
    """
    whole = next(p for p in packs if p[5] is not None)
    docs = np.frombuffer(whole[5], DOC)
    common, often = np.frombuffer(whole[2], np.uint64), np.frombuffer(whole[3], np.uint32).astype(np.int64)
    upto, staying = np.r_[0, np.cumsum(often)], np.frombuffer(whole[4], np.uint16)
    token, frequency, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
    for part, _, t, n, places, gathered, _, f in packs:
        if gathered is not None:
            continue
        t = np.frombuffer(t, np.uint32).astype(np.uint64) | (np.uint64(part) << np.uint64(32))
        n, f = np.frombuffer(n, np.uint32).astype(np.int64), np.frombuffer(f, np.uint32).astype(np.int64)
        named = n <= COMMON
        token.append(np.repeat(t[named], n[named]))
        frequency.append(np.repeat(f[named], n[named]))
        place.append(np.frombuffer(places, np.uint16))
        for i in np.flatnonzero(~named).tolist():
            k = int(np.searchsorted(common, t[i]))
            token.append(np.full(n[i], t[i]))
            frequency.append(np.full(n[i], f[i]))
            place.append(staying[upto[k] : upto[k + 1]])
    token, frequency, place = np.concatenate(token), np.concatenate(frequency), np.concatenate(place).astype(np.int64)
    rest = token >= np.uint64(parts << 32)
    frequency[rest] = 1 << 40
    order = np.lexsort((token, frequency, place))
    token, place, rest = token[order], place[order], rest[order]
    back = np.bincount(place[~rest], minlength=len(docs))  # counted ones that came back
    first = np.searchsorted(place, np.arange(len(docs)))
    pos = docs["counted"][place] - np.where(rest, 0, back[place]) + np.where(rest, 0, np.arange(len(place)) - first[place])
    kept = pos < prefix_length(docs["n"][place])  # of those not counted only prefix ones were sent; their positions are lower bounds
    return docs, (place[kept], token[kept], pos[kept])


def document_sets(docs: DataFrame) -> DataFrame:
    """For each row its doc_id, key (of the text), node (the class: a hash of the whole set),
    n_shingles and, once in a task for each class, profile; and for each prefix shingle that
    several documents have its token, node, n_shingles and pos, without a key.

    A shingle travels as 32 bits within its part of the hashes.  Tasks gather documents, count
    their shingles and deal these counts out; each part is added up in one task, and what
    several documents have goes back to those gathered together.  A shingle of many documents
    is one entry for each gathering task, so no shingle is too common for its part.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pack, counted, out = map(T._parse_datatype_string, (PACK, COUNTED_PACK, SETS))
    pack_fields, counted_fields, fields = map(arrow_type, (pack, counted, out))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Gatherer(parts, TaskContext.get().partitionId(), pack_fields)
        for batch in batches:
            for doc_id, key, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), column_sets(batch.column(1)), strict=True):
                yield from found.add(doc_id, key, s)
        yield from found.flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(counted_fields)
        for _, group in groupby(_texts(batches, *range(7)), key=lambda r: r[0]):
            packs = []
            for row in group:
                if row[5] is None:
                    packs.append(row)
                else:
                    yield from rows.add(-1, *row[1:], None)
            for row in _counted(packs) if packs else ():
                yield from rows.add(*row)
        yield from rows.rest()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_texts(batches, *range(8)), key=lambda r: r[1]):
            packs = list(group)
            found, (place, token, pos) = _prefixes(packs, parts)
            given = found["counted"] >= 0
            profiles = np.frombuffer(next(p[6] for p in packs if p[5] is not None), np.uint8).reshape(-1, PROFILE // 2)
            spread = np.zeros(len(found), int)
            spread[given] = np.arange(given.sum())
            for a in range(0, len(found), 4096):
                d, g, at = found[a : a + 4096], given[a : a + 4096], spread[a : a + 4096]
                seen = [profiles[i].tobytes() if x else None for i, x in zip(at.tolist(), g.tolist(), strict=True)]
                none = pa.nulls(len(d))
                columns = [pa.array(d["id"].copy(), mask=d["null"].copy()), d["key"].copy(), d["node"].copy(), d["n"].copy(), seen, none, none]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
            for a in range(0, len(token), 1 << 17):
                p, none = place[a : a + (1 << 17)], pa.nulls(len(place[a : a + (1 << 17)]))
                columns = [none, none, found["node"][p], found["n"][p], none, token[a : a + (1 << 17)].view(np.int64), pos[a : a + (1 << 17)].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    packs = _keyed(docs).mapInArrow(gather, pack)
    dealt = packs.repartition(parts, "part").sortWithinPartitions("part", "gathered").mapInArrow(count, counted)
    return dealt.repartition("gathered").sortWithinPartitions("gathered").mapInArrow(order, out)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): the key, a hash of the text, finds it again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))


def text_key() -> Column:
    return F.xxhash64("text")


def _node(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def shared_postings(found: DataFrame) -> DataFrame:
    """(token, node, n, pos, partners): of the prefix shingles ``found`` those of several classes.

    The classes of a shingle stand in an order by hash that differs from shingle to shingle;
    ``partners`` are those of the NEAR before that the length and positional filters let pass.
    So lists of up to NEAR + 1 classes give all their pairs, and longer ones a linear number:
    three for each further class, in half of the shingles.
    """
    schema = T._parse_datatype_string("token long, node long, n int, pos int, partners array<long>")
    fields = arrow_type(schema)
    dealt = found.select("token", "node", F.col("n_shingles").cast("int").alias("n"), "pos").repartition("token")
    ordered = dealt.sortWithinPartitions("token", F.xxhash64("token", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(5)]  # the last rows of the batch before; the fifth: given out
        for batch in batches:
            if not batch.num_rows:
                continue
            token, node, n, pos = (np.r_[h, batch.column(i).to_numpy()] for i, h in enumerate(held[:4]))
            given = np.r_[held[4], np.zeros(batch.num_rows, np.int64)]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # a class may come from several tasks
            token, node, n, pos, given = (x[fresh] for x in (token, node, n, pos, given))
            same = token[1:] == token[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            rows = np.flatnonzero(shared & (given == 0))
            if len(rows):
                yield _postings(token, node, n, pos, rows, fields)
                given[rows] = 1
            held = [x[-NEAR - 1 :] for x in (token, node, n, pos, given)]

    return ordered.mapInArrow(run, schema)


def _postings(token, node, n, pos, rows: np.ndarray, fields: pa.Schema) -> pa.RecordBatch:
    before = rows[:, None] - np.arange(1, NEAR + 1)
    real, before = before >= 0, np.maximum(before, 0)
    ok = real & (token[before] == token[rows, None]) & (node[before] != node[rows, None])
    # far down in a list: three neighbours, and those in half of the shingles only; the last round sees to the rest
    far = (rows > NEAR) & (token[np.maximum(rows - NEAR - 1, 0)] == token[rows])
    ok[:, 3:] &= ~far[:, None]
    ok &= ~(far & (token[rows] & 1 != 0))[:, None]
    ok &= _passes(n[before], pos[before], n[rows, None], pos[rows, None])
    offsets = np.r_[0, np.cumsum(ok.sum(axis=1))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[before][ok])).cast(fields.field(4).type)
    arrays = [pa.array(token[rows]), pa.array(node[rows]), pa.array(n[rows].astype(np.int32)), pa.array(pos[rows].astype(np.int32)), lists]
    return pa.RecordBatch.from_arrays(arrays, schema=fields)


def _passes(n: np.ndarray, pos: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length and positional filter: what can be common from this shingle on suffices.

    A linked pair passes at its first common shingle, before which nothing is common; at later
    ones it may fail.
    """
    n, m = n.astype(np.int64), m.astype(np.int64)
    needed = -(-PERCENT * (n + m) // (100 + PERCENT))
    bound = 1 + np.minimum(n - pos - 1, m - other - 1)
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (bound >= needed)


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> Table:
    """Of distinct ``pairs`` (a, b), those whose whole sets are similar enough.

    The class with more pairs is the hub.  Its partners are dealt in parts, each with one copy of
    the hub's text; the texts travel, as their sets are larger.
    """
    left = classes.select(F.col("node").alias("a"), F.col("key").alias("ka"), F.col("n_shingles").alias("na"), F.col("profile").alias("pa"))
    right = classes.select(F.col("node").alias("b"), F.col("key").alias("kb"), F.col("n_shingles").alias("nb"), F.col("profile").alias("pb"))
    schema = T._parse_datatype_string("a long, b long")
    with scratch() as keep:
        likely = stored(_suffix_filter(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb", "ka", "kb")), "pairs")
        degree = likely.select(F.col("a").alias("node")).union(likely.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        da, db = (degree.select(F.col("node").alias(c), F.col("degree").alias(f"d{c}")) for c in "ab")
        sized = likely.join(da, "a").join(db, "b")
        swap = (F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") < F.col("a")))
        hub, partner = F.struct("a", F.col("ka").alias("key")), F.struct(F.col("b").alias("a"), F.col("kb").alias("key"))
        sized = sized.select(F.when(swap, partner).otherwise(hub).alias("hub"), F.when(swap, hub).otherwise(partner).alias("partner"), F.greatest("da", "db").alias("d"))
        part = F.pmod(F.xxhash64("partner.a"), F.ceil(F.col("d") / PARTNERS))
        dealt = stored(sized.select("hub", part.alias("part"), "partner"), "dealt")
        partners = dealt.select(F.col("hub.a").alias("a"), "part", F.col("partner.a").alias("b"), F.col("partner.key").alias("key"))
        hubs = dealt.select(F.col("hub.a").alias("a"), "part", F.lit(None).cast("long").alias("b"), F.col("hub.key").alias("key")).distinct()
        places = hubs.unionByName(partners)
        met = _texts_of(docs, dealt.select("hub.key").union(dealt.select("partner.key")).distinct()).join(places, "key").select("a", "part", "b", "text")
        met = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, own = None, None
            for batch in batches:
                found = []
                for a, part, b, s in zip(*(batch.column(k).to_pylist() for k in range(3)), column_sets(batch.column(3)), strict=True):
                    if b is None:
                        hub, own = (a, part), s
                    elif hub == (a, part) and linked(own, s):
                        found.append((a, b))
                if found:
                    x, y = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=arrow_type(schema))

        edges = written(met.mapInArrow(run, schema), "edges")
        keep(edges)
    return edges


def _near(n, m, apart: np.ndarray) -> np.ndarray:
    """Suffix filter: sets of sizes n and m that differ in ``apart`` members at least."""
    return n + m - apart >= 2 * (-(-PERCENT * (n + m) // (100 + PERCENT)))


def _suffix_filter(pairs: DataFrame) -> DataFrame:
    """Drops pairs whose counts by ranges of hashes differ too much for the needed overlap."""
    schema = T._parse_datatype_string("a long, b long, ka long, kb long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, PROFILE // 2) for k in (4, 5))
            fits = pa.array(_near(batch.column(2).to_numpy(), batch.column(3).to_numpy(), _apart(x, y)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(fits) for k in (0, 1, 6, 7)], schema=arrow_type(schema))

    return pairs.mapInArrow(run, schema)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the ``wanted`` keys, each once, and a few others.

    A Bloom filter, sized by their number, spares most other texts the way to the join with the
    keys themselves, which decides; a task gives a text once as far as its memory goes.
    """
    context = docs.sparkSession.sparkContext
    wanted = stored(wanted, "wanted")
    bits = max(16, min(BLOOM_MOST, BLOOM_SHARE * wanted.count()).bit_length())
    shared = context.broadcast(_bloom(wanted, bits))  # BLOOM_MOST bits at most
    schema = T._parse_datatype_string("key long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = shared.value, set()
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for at in _bits(batch.column(0).to_numpy().view(np.uint64), bits):
                hit &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            rows = np.flatnonzero(hit)
            fresh = []
            for i, key in zip(rows.tolist(), batch.column(0).take(pa.array(rows)).to_pylist(), strict=True):
                if key not in seen:
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(key)
                    fresh.append(i)
            yield batch.take(pa.array(fresh, pa.int64()))

    found = _keyed(docs).where("text is not null").select("key", "text").mapInArrow(run, schema)
    return found.groupBy("key").agg(F.first("text").alias("text"))


def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each key in a Bloom filter of 2**bits."""
    h = mixed(keys)
    return [h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)]


def _bloom(wanted: DataFrame, bits: int) -> np.ndarray:
    schema = T._parse_datatype_string("word long, bits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), bits))
            mark = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(mark.view(np.int64))], schema=arrow_type(schema))

    words = wanted.select("key").mapInArrow(run, schema).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _pairs_across(postings: DataFrame, labels: DataFrame | None, classes: DataFrame) -> DataFrame:
    """All pairs of classes in different components that share a prefix shingle and pass the filters.

    A list of over BLOCK classes is cut into blocks; every two blocks meet once, each in its task.
    With ``labels``, lists whose pairs the first round has had are left out.  In lists of over
    SHORT the suffix filter is applied before pairs are given out.
    """
    postings = postings.drop("partners")
    if labels is not None:
        labelled = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        labelled = postings.withColumn("label", F.col("node"))
    lists = labelled.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where(F.lit(labels is None) | (F.col("size") > NEAR + 1)).where("low < high")
    rows = stored(labelled.join(lists.select("token", "size"), "token"), "lists")  # the caller's block drops it
    short = rows.where(F.col("size") <= SHORT).withColumn("profile", F.lit(None).cast("binary"))
    long = rows.where(F.col("size") > SHORT).join(classes.select("node", "profile"), "node")
    rows = short.unionByName(long).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "node", "pos", "label", "profile")
    ordered = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "node")
    schema = T._parse_datatype_string("a long, b long")

    def pairs(group: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j, own, n, node, pos, label = (np.array(c) for c in zip(*(g[:-1] for g in group), strict=True))
        profiles = np.frombuffer(b"".join(g[-1] for g in group), np.uint8).reshape(-1, PROFILE // 2) if group[0][-1] is not None else None
        for k in range(1, len(n)):
            low = np.searchsorted(n[:k], -(-PERCENT * n[k] // 100))
            # a pair of one block is made where both its sides are that block
            fits = (label[low:k] != label[k]) & ((own[low:k] != own[k]) | (i[k] == j[k])) & _passes(n[low:k], pos[low:k], np.full(k - low, n[k]), np.full(k - low, pos[k]))
            at = low + np.flatnonzero(fits)
            if len(at) and profiles is not None:
                at = at[_near(n[at], n[k], _apart(profiles[at], profiles[k]))]
            if len(at):
                yield node[at], np.full(len(at), node[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, seen = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if seen:
                a, b = (np.concatenate(c) for c in zip(*seen, strict=True))
                seen.clear()
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], schema=arrow_type(schema))

        held = 0
        for row in _texts(batches, *range(9)):
            if row[:3] != now:
                for p in pairs(group) if len(group) > 1 else ():
                    seen.append(p)
                    held += len(p[0])
                    if held > 100_000:
                        yield from out()
                        held = 0
                now, group = row[:3], []
            group.append(row[1:])
        for p in pairs(group) if len(group) > 1 else ():
            seen.append(p)
        yield from out()

    return ordered.mapInArrow(run, schema)


def link_classes(docs: DataFrame, all_pairs: bool = False) -> tuple[Table, Table]:
    """(document sets, links): the rows of ``document_sets`` and the linked pairs of classes (a, b).

    ``all_pairs``: every linked pair, verified once each.  Otherwise links that suffice for the
    components: pairs that earlier rounds have joined are not looked at.
    """
    with scratch() as keep:
        found = written(document_sets(docs), "sets")
        sets = written(found.frame.where("key is not null").select("doc_id", "key", "node", "n_shingles"), "documents")
        classes = found.frame.where("profile is not null").select("node", "key", "n_shingles", "profile").dropDuplicates(["node"])
        classes = stored(classes, "classes")
        postings = written(shared_postings(found.frame.where("token is not null")), "postings")
        found.drop()
        if all_pairs:
            links = verified(_distinct_pairs(_pairs_across(postings.frame, None, classes)), classes, docs)
        else:
            first = stored(_distinct_pairs(postings.frame.select(F.col("node").alias("a"), F.explode("partners").alias("b"))), "first")
            near = verified(first, classes, docs)
            labels = least_labels(near.frame)
            rest = _distinct_pairs(_pairs_across(postings.frame, labels.frame, classes)).join(first, ["a", "b"], "left_anti")
            links = written(near.frame.union(verified(rest, classes, docs).frame), "links")
        keep(sets, links)
    return sets, links


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document sets and, for each class with shingles, (node, label of its component).

    Their two tables are read by the result and stay for it.
    """
    with scratch() as keep:
        sets, links = link_classes(docs)
        labels = least_labels(links.frame)
        keep(sets, labels)
    nodes = sets.frame.where("n_shingles > 0").select("node").distinct()
    return sets.frame, nodes.join(labels.frame, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def join_components(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, n_shingles, component_id.  An empty set is its own component."""
    sets, labels = _labelled(docs)
    least = sets.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node")
    component = least.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = least.join(component, "label").select(F.col("node").alias("_node"), "component_id")
    out = sets.select("doc_id", "node", "n_shingles").join(by_class, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that with the least id (null
    last), then the least text key.  Rows with empty sets stay; of rows equal in id and text one does."""
    sets, labels = _labelled(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    least = sets.where("n_shingles > 0").groupBy("node").agg(F.min(place).alias("place")).join(labels, "node")
    chosen = least.groupBy("label").agg(F.min("place").alias("place")).select("place.doc_id", "place.key")
    chosen = chosen.unionByName(sets.where("n_shingles = 0").select("doc_id", "key")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    keyed = docs.withColumn("_text_key", text_key())
    met = keyed.join(chosen.distinct(), (F.col("_text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return met.dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
