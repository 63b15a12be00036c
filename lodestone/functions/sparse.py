"""Hashed sparse vectors: identifiers whole and by parts, BLAKE2b buckets, unit length. One vector a row, no shuffle."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import map_batches

#: Letters, digits and the joiners of technical identifiers; the number of dimensions.
TOKEN = re.compile(r"[A-Za-zÀ-ỹĐđ0-9]+(?:[._/-][A-Za-zÀ-ỹĐđ0-9]+)*")
DIMENSIONS = 1_048_576


def tokens(text: str | None) -> Iterator[str]:
    """Folded tokens in order; a joined one is followed by its parts of two or more characters."""
    for found in TOKEN.findall(text or ""):
        yield found.casefold()
        if any(c in found for c in "_./-"):
            yield from (p.casefold() for p in re.split(r"[._/-]+", found) if len(p) >= 2)


def bucket(token: str, dimensions: int = DIMENSIONS) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big") % dimensions


def vector(text: str | None, dimensions: int = DIMENSIONS) -> dict[int, float]:
    """1 + ln of each bucket's count, ascending by bucket, scaled to unit length; empty for a text without tokens."""
    counts = Counter(bucket(t, dimensions) for t in tokens(text))
    weights = {i: 1 + math.log(n) for i, n in sorted(counts.items())}
    norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    return {i: w / norm for i, w in weights.items()}


def vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, indices, values) of every row, hashed in Arrow batches (Spark has no BLAKE2b)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, indices, values = batch.slice(at, 500), [], []
                for body in part.column(1).to_pylist():
                    counts: Counter = Counter()
                    for t, n in Counter(tokens(body)).items():
                        if t not in known:
                            if len(known) > 200_000:
                                known.clear()
                            known[t] = bucket(t, dimensions)
                        counts[known[t]] += n
                    weights = [1 + math.log(counts[i]) for i in sorted(counts)]
                    norm = math.sqrt(sum(w * w for w in weights)) or 1.0
                    indices.append(sorted(counts))
                    values.append([w / norm for w in weights])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(indices, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], names=["key", "indices", "values"])

    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, indices array<long>, values array<double>").withColumnRenamed("key", key)


def dot(indices: Column, values: Column, query: dict[int, float]) -> Column:
    """The dot product of a stored vector with a query's; only the query's buckets are looked at."""
    out = F.lit(0.0)
    for i, w in query.items():
        at = F.array_position(indices, F.lit(i).cast("long"))
        out = out + F.when(at > 0, F.get(values, (at - 1).cast("int")) * w).otherwise(0.0)
    return out
