"""Exact duplicates by Grace hash partitioning.

Every task first gathers its own rows in an open-addressing table of whole contents, so that a content of very many rows
leaves a task as one record. Records are dealt by content hash to so many buckets that an average one fits a table, and a
bucket is read through a table of bounded bytes: records that meet their content in it are settled however many they are; once it is full,
records of other contents spill, are written out and dealt anew by other hash bits, until nothing spills. Hashes only choose
buckets and slots; contents are compared byte by byte. A content of more records than a task should read is
gathered in salted parts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ship, stored, text_bytes

#: Bytes of distinct contents, and of what a table keeps beside each, from which a table takes no more.
TABLE_BYTES, RECORD_BYTES = 64 << 20, 300
#: Bytes that the records of a bucket are meant to have together.
BUCKET_BYTES = 32 << 20
#: Records of one content from which it is gathered in parts of about so many.
HOT_RECORDS = 4096


class Table:
    """Open addressing with linear probing; the contents lie end to end in one buffer."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.ends = [0]
        self.arena = bytearray()

    def __len__(self) -> int:
        return len(self.hashes)

    def content(self, at: int) -> bytes:
        return bytes(self.arena[self.ends[at] : self.ends[at + 1]])

    def find(self, content: bytes, hashed: int) -> int:
        """The number of an equal content, or -1 - slot of the free slot where it belongs."""
        mask = len(self.slots) - 1
        slot = hashed & mask
        while (at := self.slots[slot]) >= 0:
            if self.hashes[at] == hashed and self.ends[at + 1] - self.ends[at] == len(content) and self.arena.startswith(content, self.ends[at]):
                return at
            slot = (slot + 1) & mask
        return -1 - slot

    def add(self, content: bytes, hashed: int, slot: int) -> int:
        at = len(self.hashes)
        self.slots[slot] = at
        self.hashes.append(hashed)
        self.arena += content
        self.ends.append(len(self.arena))
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (len(self.slots) * 2)
        mask = len(self.slots) - 1
        for at, hashed in enumerate(self.hashes):
            slot = hashed & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = at

    def full(self, limit: int) -> bool:
        return len(self.arena) + RECORD_BYTES * len(self.hashes) >= limit


def _above(a: tuple, b: tuple) -> bool:
    """Whether (key, row) ``a`` stays rather than ``b``: the larger key, null below all; of equal keys the smaller row."""
    if a[0] == b[0]:
        return a[1] < b[1]
    return b[0] is None or a[0] is not None and a[0] > b[0]


#: A record: a group of equal contents that a task found, its content's hash, bytes and digest, the row that stays and the number of rows.
_RECORD = ("grp", "hash", "content", "digest", "top", "win", "n")


def _types(kind: pa.DataType) -> list[pa.DataType]:
    return [pa.int64(), pa.int64(), pa.binary(), pa.binary(), kind, pa.int64(), pa.int64()]


class Groups:
    """A table with a record beside each content."""

    def __init__(self):
        self.table, self.names, self.digests, self.best, self.counts = Table(), [], [], [], []

    def add(self, content: bytes, hashed: int, slot: int, name: int, digest: bytes, best: tuple, n: int) -> int:
        for column, value in ((self.names, name), (self.digests, digest), (self.best, best), (self.counts, n)):
            column.append(value)
        return self.table.add(content, hashed, slot)

    def count(self, at: int, best: tuple, n: int) -> None:
        self.counts[at] += n
        if _above(best, self.best[at]):
            self.best[at] = best

    def records(self, kind: pa.DataType, contents: bool) -> Iterator[list[pa.Array]]:
        for a in range(0, len(self.table), 1024):
            at = slice(a, min(a + 1024, len(self.table)))
            hashes = np.array(self.table.hashes[at], np.uint64).view(np.int64)
            whole = [self.table.content(i) if contents else None for i in range(at.start, at.stop)]
            top, win = zip(*self.best[at], strict=True)
            yield [pa.array(x, t) for x, t in zip((self.names[at], hashes, whole, self.digests[at], top, win, self.counts[at]), _types(kind), strict=True)]


def _gather(kind: pa.DataType, limit: int):
    """Rows (key, text) to rows (key, row, grp) and, once a table is full or a task ends, records of its groups."""

    def ended(groups: Groups) -> Iterator[pa.RecordBatch]:
        for columns in groups.records(kind, True):
            none = pa.nulls(len(columns[0]))
            yield pa.RecordBatch.from_arrays([none.cast(kind), none.cast(pa.int64()), *columns], names=["key", "row", *_RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, groups = TaskContext.get().partitionId() << 33, Groups()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            # A-Z to a-z over the bytes; those of other characters are above them.
            raw, offsets, found = LOWER[data].tobytes(), offsets.tolist(), []
            for i, key in enumerate(batch.column(0).to_pylist()):
                content = raw[offsets[i] : offsets[i + 1]]
                hashed = xxhash.xxh64_intdigest(content)
                own = groups.table.find(content, hashed)
                if own < 0 and groups.table.full(limit):
                    yield from ended(groups)
                    groups = Groups()
                    own = groups.table.find(content, hashed)
                if own < 0:
                    own = groups.add(content, hashed, -1 - own, first + i, hashlib.sha256(content).digest(), (key, first + i), 1)
                else:
                    groups.count(own, (key, first + i), 1)
                found.append(groups.names[own])
            n = batch.num_rows
            none = [pa.nulls(n).cast(t) for t in _types(kind)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(first, first + n)), pa.array(found, pa.int64()), *none], names=["key", "row", *_RECORD])
            first += n
        yield from ended(groups)

    return run


def _settle(kind: pa.DataType, limit: int, contents: bool):
    """Records of whole buckets, each with the group ``lead`` that its content is gathered in; a record without one spills.

    A lead's own record comes last and has its content's totals, and the content itself where ``contents``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, names = Groups(), ["lead", *_RECORD]
        for batch in batches:
            spilled, members = [], []
            group, hashes, digests, top, win, n = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
            data, offsets = text_bytes(batch.column(2))
            raw, offsets = data.tobytes(), offsets.tolist()
            for i, signed in enumerate(hashes):
                content, hashed = raw[offsets[i] : offsets[i + 1]], signed & (1 << 64) - 1
                own = groups.table.find(content, hashed)
                if own >= 0:
                    groups.count(own, (top[i], win[i]), n[i])
                    members.append((groups.names[own], group[i]))
                elif groups.table.full(limit):
                    spilled.append(i)
                else:
                    groups.add(content, hashed, -1 - own, group[i], digests[i], (top[i], win[i]), n[i])
            if members:
                lead, own = zip(*members, strict=True)
                none = [pa.nulls(len(own)).cast(t) for t in _types(kind)[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(own, pa.int64()), *none], names=names)
            if spilled:
                rest = batch.take(pa.array(spilled))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(spilled)).cast(pa.int64()), *rest.columns], names=names)
        for columns in groups.records(kind, contents):
            yield pa.RecordBatch.from_arrays([columns[0], *columns], names=names)

    return run


def _passed(records: DataFrame, kind: str, level: int, contents: bool, *salt: Column) -> DataFrame:
    """Stored (lead, grp, ...) of ``records`` after one pass through the tables of their buckets."""
    session = records.sparkSession
    held = records.agg(F.sum(F.octet_length("content") + F.lit(RECORD_BYTES))).first()[0] or 0
    buckets = max(-(-held // BUCKET_BYTES), min(session.sparkContext.defaultParallelism, 1 + (held >> 20)))
    rows = records.select(*_RECORD, *salt).repartition(int(buckets), F.xxhash64("hash", F.lit(level), *salt)).select(*_RECORD)
    return stored(rows.mapInArrow(_settle(_arrow(kind), TABLE_BYTES, contents), f"lead long, {_columns(kind)}"))


def _spilled(todo: DataFrame, kind: str) -> DataFrame:
    """All records with their ``lead``: passes over what spilled, each with other buckets, until nothing is left.

    A table takes at least one content, so every pass settles something in each of its buckets.
    """
    done, level = None, 0
    while True:
        level += 1
        passed = _passed(todo, kind, level, False)
        settled = passed.filter(F.col("lead").isNotNull())
        done = settled if done is None else done.unionByName(settled)
        todo = passed.filter(F.col("lead").isNull()).select(*_RECORD)
        if todo.isEmpty():
            return done


def _columns(kind: str) -> str:
    return f"grp long, hash long, content binary, digest binary, top {kind}, win long, n long"


def _arrow(kind: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "date": pa.date32()}
    if kind not in kinds:
        raise TypeError(f"keys of type {kind} are not ordered here; use one of {', '.join(kinds)}")
    return kinds[kind]


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, contents): key, row (a number of its own) and grp of every row; and lead, keep, win, n and digest of every grp.

    Groups with one ``lead`` have one content. ``keep`` is the largest key of its rows, ``win`` the row that stays, ``n`` their number.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    gathered = stored(plain.mapInArrow(_gather(_arrow(kind), TABLE_BYTES), f"key {kind}, row long, {_columns(kind)}"))
    rows = gathered.filter(F.col("row").isNotNull()).select("key", "row", "grp")
    todo = gathered.filter(F.col("row").isNull()).select(*_RECORD)
    # Of hashes as frequent as this there are at most a HOT_RECORDS-th of the records.
    hot = stored(todo.groupBy("hash").agg(F.count("*").alias("records")).filter(F.col("records") > HOT_RECORDS))
    via = None
    if not hot.isEmpty():
        marked = todo.join(hot, "hash", "left")
        salted = marked.filter(F.col("records").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("grp"), F.ceil(F.col("records") / HOT_RECORDS)))
        # One pass: what spills here goes on as it is.
        parts = _passed(salted, kind, 0, True, F.col("salt")).withColumn("lead", F.coalesce("lead", "grp"))
        via = parts.select(F.col("grp").alias("part"), F.col("lead").alias("grp"))
        todo = marked.filter(F.col("records").isNull()).select(*_RECORD).unionByName(parts.filter(F.col("lead") == F.col("grp")).select(*_RECORD))
    settled = _spilled(todo, kind)
    named = settled.select("grp", "lead")
    if via is not None:
        named = named.join(via, "grp", "left").select(F.coalesce("part", "grp").alias("grp"), "lead")
    totals = settled.filter(F.col("lead") == F.col("grp")).select("lead", F.col("top").alias("keep"), "win", "n", "digest")
    return rows, named.join(totals, "lead")


def dedupe(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, keep_id, group_size, kept and digest (the SHA-256 of the normalised text).

    Texts are equal if they are the same bytes after A-Z became a-z; null counts as empty. The row with the largest key
    stays (``kept``), null keys below all others; of rows equal in key too, exactly one. A group of null keys alone keeps one and has
    a null keep_id. Other columns are ignored; an empty table gives no rows.
    """
    rows, contents = groups(docs, text, key)
    named = rows.join(contents, "grp")
    return named.select(F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("win")).alias("kept"), "digest")
