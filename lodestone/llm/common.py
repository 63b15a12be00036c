"""Shared parts of the training-data operators: byte-level tokenising with numpy, and shared storage.

Texts are scanned as the UTF-8 bytes of an Arrow column, whole batches at a time; a block of
``BLOCK_BYTES`` bounds the memory of a worker however long a batch is (one longer text makes a
block of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, ship, stored  # noqa: F401  the operators take them from here

BLOCK_BYTES = 1 << 20
#: ASCII white space that ends a word in most contracts.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])

def is_local(spark: SparkSession, where: str) -> bool:
    """Whether Spark resolves ``where`` to a mounted folder, which plain file calls reach; a path without scheme is its default file system's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().startswith("file:")


def local_path(uri: str) -> str:
    from urllib.parse import unquote, urlsplit

    return unquote(urlsplit(uri).path) if uri.startswith("file:") else uri


def _trim() -> None:
    """Give freed memory back to the system: a worker lives for many stages."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def ranges(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about ``limit`` bytes together; row i has the bytes ``offsets[i]:offsets[i + 1]``."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end
    pa.default_memory_pool().release_unused()
    _trim()


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about ``limit`` bytes together."""
    yield from ranges(text_bytes(batch.column(column))[1], limit)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if ends is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def table_of(chars: bytes, inverse: bool = False) -> np.ndarray:
    """A 256-entry truth table of bytes."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return ~out if inverse else out


#: Bytes of words `[^\x20\x09-\x0D]+`.
WORD = table_of(SPACE_BYTES, inverse=True)
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a block: byte ranges ``starts``, ``ends`` and, by row, ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD):
        self.data, self.offsets = data, offsets
        mask = np.zeros(len(data) + 2, bool)
        mask[1:-1] = is_word[data]
        begin, end = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begin[inner] = mask[1:-1][inner]
        end[inner - 1] = mask[1:-1][inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return span_hashes(self.data, self.starts, self.ends)


_ODD = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers.append(out)
        del _powers[:-2]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Bytes beyond which a polynomial's hash is not trusted: texts with equal ones can be built.
SHORT = 32


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: of short ones from prefix sums of a polynomial modulo 2**64, of the few long ones XXH64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[data] * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), SHORT)
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` words in a row, at every position (the last ``n - 1`` positions have none)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    # Multipliers without arithmetic relations: else windows with some words exchanged would collide.
    factors = mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD)) | np.uint64(1)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += words[i : i + len(out)] * factors[i]
    return mix(out)


def within_rows(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which ``n`` words in a row belong to one row, given the rows' first words."""
    total = int(first[-1]) if len(first) else 0
    good = np.ones(max(0, total - n + 1), bool)
    for back in range(1, n):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < len(good))]
        good[at] = False
    return np.flatnonzero(good)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def environment_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def join_words(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): a block's kept words, each followed by one space, and where each lies."""
    a, b = (words.starts, words.ends) if keep is None else (words.starts[keep], words.ends[keep])
    lengths = b - a
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    index = np.repeat(a - starts, lengths + 1)
    index += np.arange(len(index))
    index[ends] = 0
    out = words.data[index] if len(index) else words.data[:0].copy()
    out[ends] = 32
    return out, starts, ends


def input_bytes(df: DataFrame, text: str) -> int:
    """Spark's own estimate of a table's size; where it has none (no files below, or joins), the bytes of the texts."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 50 else df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
