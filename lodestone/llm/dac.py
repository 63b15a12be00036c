"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id; a bitmap says which ids go
on, and level l + 1 holds the next chunk of those. A rank directory (set bits before each 512-bit
word group) makes the place of an id's next chunk a lookup, so any token is read without decoding its
neighbours.

File layout, little-endian, after an eight-byte magic: int64 part, sequence, documents, ids, levels; the
documents' keys (int64), key flags (uint8, 0 for a null key) and token counts (int64); then for each level int64
length, chunks, bitmap and directory (uint32). A final newline ends the file.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoded_blocks, encoder
from .common import environment_path, is_local, local_path, shared_dir, ship, stored

MAGIC = b"LSDAC001"
GROUP = 512
#: Ids of a file; one longer document makes a longer file.
FILE_IDS = 4_000_000
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Levels:
    """Directly addressable codes of an id array."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Levels:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest > 0xFF
            bitmap = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(bitmap) // (GROUP // 8)) * (GROUP // 8), np.uint8)
            padded[: len(bitmap)] = _BITS[bitmap]
            counts = padded.reshape(-1, GROUP // 8).sum(axis=1, dtype=np.uint32)
            levels.append(((rest & 0xFF).astype(np.uint8), bitmap, np.cumsum(counts, dtype=np.uint32) - counts))
            if not more.any():
                return cls(levels)
            rest = rest[more] >> np.uint32(8)

    def get(self, i: int) -> int:
        """The id at place ``i``."""
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            group = i // GROUP
            before = bitmap[group * (GROUP // 8) : i >> 3]
            i = int(ranks[group]) + int(_BITS[before].sum()) + int(_BITS[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every id, in order."""
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if len(out):
                here[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = here
        return out


def pack(part: int, sequence: int, keys: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes."""
    codes = Levels.of(ids)
    out = [MAGIC, np.array([part, sequence, len(keys), len(ids), len(codes.levels)], "<i8").tobytes(), keys.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), counts.astype("<i8").tobytes()]
    for chunks, bitmap, ranks in codes.levels:
        out += [np.array([len(chunks)], "<i8").tobytes(), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(out)


def header(data: bytes) -> tuple[int, int, int, int, int]:
    if data[:8] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    return tuple(np.frombuffer(data, "<i8", 5, 8).tolist())


HEADER_BYTES = 48
Read = Callable[[int, int], bytes]


class File:
    """A file of codes that is read by range: its header and document table once, then only what is asked for."""

    def __init__(self, read: Read):
        self.read = read
        self.part, self.sequence, docs, self.n, levels = header(read(0, HEADER_BYTES))
        table = read(HEADER_BYTES, 17 * docs)
        self.keys, self.known, self.counts = np.frombuffer(table, "<i8", docs), np.frombuffer(table, "u1", docs, 8 * docs), np.frombuffer(table, "<i8", docs, 9 * docs)
        self.ends = np.cumsum(self.counts)
        #: Of each level: where its chunks, its bitmap and its directory begin.
        self.levels: list[tuple[int, int, int]] = []
        at = HEADER_BYTES + 17 * docs
        for _ in range(levels):
            n = int(np.frombuffer(read(at, 8), "<i8")[0])
            self.levels.append((at + 8, at + 8 + n, at + 8 + n - (-n // 8)))
            at += 8 + n - (-n // 8) - 4 * (-n // GROUP)

    def _rank(self, level: int, i: int) -> int:
        """How many ids before place ``i`` of a level go on, by its rank directory."""
        _, bitmap, ranks = self.levels[level]
        group, inside = divmod(i, GROUP)
        if not inside and not i:
            return 0
        if not inside:  # the end of a group: the directory may have no entry beyond it
            group, inside = group - 1, GROUP
        before = np.frombuffer(self.read(ranks + 4 * group, 4), "<u4")[0]
        bits = np.frombuffer(self.read(bitmap + group * (GROUP // 8), -(-inside // 8)), np.uint8)
        return int(before) + int(np.unpackbits(bits, count=inside, bitorder="little").sum())

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids at places ``a`` to ``b``: a range of each level, found by its rank directory."""
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= np.frombuffer(self.read(chunks + a, b - a), np.uint8).astype(np.uint32) << np.uint32(shift)
            bits = np.frombuffer(self.read(bitmap + a // 8, (b + 7) // 8 - a // 8), np.uint8)
            more = np.unpackbits(bits, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if not more.any():
                break
            a = self._rank(level, a)
            b, where, shift = a + int(more.sum()), where[more], shift + 8
        return out

    def document(self, i: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Tokens ``a`` to ``b`` (its end) of document ``i`` of the file."""
        end = int(self.ends[i])
        begin = end - int(self.counts[i])
        return self.ids(begin + a, end if b is None else min(end, begin + b))


def unpack(data: bytes) -> tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray, Levels]:
    """(part, sequence), keys, key flags, token counts and codes of a whole file."""
    file, levels = File(lambda at, n: data[at : at + n]), []
    for chunks, bitmap, ranks in file.levels:
        n = -(-(ranks - bitmap) * 8 // GROUP)
        levels.append((np.frombuffer(data, "u1", bitmap - chunks, chunks), np.frombuffer(data, "u1", ranks - bitmap, bitmap), np.frombuffer(data, "<u4", n, ranks)))
    return (file.part, file.sequence), file.keys, file.known, file.counts, Levels(levels)


def write(docs: DataFrame, where: str, tokenizer: str = "byte_bpe_50k.json", end: int | None = 2, text: str = "text", key: str = "doc_id") -> None:
    """Encode every row and write the ids, in ascending key order, as files below ``where``.

    Rows are dealt out by ranges of key and text hash, so parts follow each other and no key, null included, is bound to one
    task; null keys come first, and rows with equal keys are ordered by a hash of their texts. Keys are integers. Null and empty texts have only the end id
    (nothing where ``end`` is None). Spark's committing text writer stores each file, so a lost
    executor leaves no torn file.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be an integer column")
    ship(docs.sparkSession)
    path = environment_path(tokenizer)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = (F.col("key").asc_nulls_first(), F.col("text_hash"))
    ranged = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, sequence = encoder(path), TaskContext.get().partitionId(), 0
        keys, known, counts, ids, n = [], [], [], [], 0
        tail = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)

        def file() -> pa.RecordBatch:
            blob = pack(part, sequence, np.concatenate(keys), np.concatenate(known), np.concatenate(counts), np.concatenate(ids))
            for held in (keys, known, counts, ids):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["file"])

        for batch in batches:
            for a, b, (flat, bounds, _, _) in encoded_blocks(batch, 1, coder):
                column = batch.column(0).slice(a, b - a)
                keys.append(column.fill_null(0).to_numpy())
                known.append(column.is_valid().to_numpy(zero_copy_only=False))
                if len(tail):
                    flat = np.insert(flat, bounds[1:], tail[0])
                counts.append(np.diff(bounds) + len(tail))
                ids.append(flat)
                n += len(flat)
                if n >= FILE_IDS:
                    yield file()
                    sequence, n = sequence + 1, 0
        if keys:
            yield file()

    files = ranged.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(where)


def _files(batch: pa.RecordBatch) -> Iterator[Read]:
    """Range readers of a batch's files: in place where they are mounted, else of what Spark loaded."""
    if batch.num_columns > 1:
        for value in batch.column(1):
            view = memoryview(value.as_buffer())
            yield lambda at, n, view=view: view[at : at + n]
    else:
        for name in batch.column(0).to_pylist():
            with open(local_path(name), "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
                yield lambda at, n, m=m: m[at : at + n]


def read(spark, where: str, key: str = "doc_id") -> DataFrame:
    """One row per document of the files: key, start (ids of all documents before it), n_tokens, ids_crc32; each document's ids are read by range."""
    ship(spark)
    columns = ["path"] if is_local(spark, where) else ["path", "content"]
    files = spark.read.format("binaryFile").load(where).filter("length > 0").select(*columns)  # no rows leave an empty file

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [header(bytes(r(0, HEADER_BYTES))) for r in _files(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1, 3)], names=["part", "sequence", "ids"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ranged in _files(batch):
                file = File(ranged)
                part, sequence, keys, known, counts, ends = file.part, file.sequence, file.keys.copy(), file.known, file.counts.copy(), file.ends
                sums = [zlib.crc32(file.document(i).astype("<u4").tobytes()) for i in range(len(keys))]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, sequence)), pa.array(keys, pa.int64(), mask=known == 0), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["part", "sequence", "key", "inside", "n_tokens", "ids_crc32"],
                )

    index = stored(files.mapInArrow(heads, "part long, sequence long, ids long"))
    parts = index.groupBy("part").agg(F.sum("ids").alias("all_ids"))  # one row for each written partition
    first = parts.withColumn("before_part", F.coalesce(F.sum("all_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all_ids")
    inner = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = index.withColumn("before", inner).join(first, "part").select("part", "sequence", (F.col("before") + F.col("before_part")).alias("before"))
    found = files.mapInArrow(documents, "part long, sequence long, key long, inside long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "sequence"]).select(F.col("key").alias(key), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int | None = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ``docs`` to a new folder of the shared storage and read the files back."""
    where = shared_dir(docs.sparkSession)
    write(docs, where, tokenizer, end, text, key)
    return read(docs.sparkSession, where, key)
