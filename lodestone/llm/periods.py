"""Periodic runs of words: masking by repeated k-grams, then Main-Lorentz division on what survives.

A run of ``n`` words and period ``q`` equals itself ``q`` words on, over ``n - q`` words. The least such overlap, over
all periods that a run may have, is ``k``: every word of a run lies in a window of ``k`` words that its document holds twice.
Words outside such windows are masked, and a run lies in one stretch of words that survive. Stretches are halved again
and again, and a run crosses the middle of a part that contains it whole: either the middle word or the word one period before
it begins a common extension of the run with itself. All parts of a level, of all documents of a block,
are searched at once; extensions are found by hashes and every run is compared word by word before it is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, _power_tables, blocks, gram_hashes, join_words, mix, row_of, ship, text_bytes, within_rows

LEAST, POWER = 24, 3
#: Pairs of a middle and a period that are tried at once.
PAIRS = 1 << 20


def least_overlap(least: int = LEAST, power: int = POWER) -> int:
    """The fewest words that a run of ``max(least, power * period)`` words shares with itself one period on."""
    return min(max(least, power * q) - q for q in range(1, least // power + 2))


def surviving(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in ``k`` words in a row that their row holds twice or more."""
    at = within_rows(first, k)
    grams = mix(gram_hashes(hashes, k)[at] ^ mix(row_of(first)[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][again]] = True
    twice[order[:-1][again]] = True
    steps = np.zeros(len(hashes) + 1, np.int64)
    steps[at[twice]] += 1
    np.subtract.at(steps, at[twice] + k, 1)
    return np.cumsum(steps[:-1]) > 0


def stretches(mask: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of at least ``least`` marked words in a row."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[first] = True
    begin = mask & (edge[:-1] | ~np.concatenate(([False], mask[:-1])))
    end = mask & (edge[1:] | ~np.concatenate((mask[1:], [False])))
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= least
    return a[long], b[long]


class Extensions:
    """Common extensions of places of a sequence of codes, by prefix sums of a polynomial modulo 2**64.

    Equal words have equal sums, so an extension is never too short; one that is too long by a collision does not pass ``periodic``.
    """

    def __init__(self, codes: np.ndarray, most: int):
        up, self.down = _power_tables(len(codes) + 1)
        self.n, self.steps = len(codes), [1 << b for b in range(most.bit_length(), -1, -1)]
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64)) * up[: len(codes)], out=self.sums[1:])

    def _same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from ``i`` and ``j`` (the later one) on."""
        out = np.zeros(len(i), np.int64)
        for step in self.steps:
            ok = np.flatnonzero(j + out + step <= self.n)
            out[ok[self._same((i + out)[ok], (j + out)[ok], step)]] += step
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common before ``i`` (the earlier one) and ``j``."""
        out = np.zeros(len(i), np.int64)
        for step in self.steps:
            ok = np.flatnonzero(i - out - step >= 0)
            out[ok[self._same((i - out - step)[ok], (j - out - step)[ok], step)]] += step
        return out


class Compared:
    """The same by comparing words one by one: for blocks in which hashes collide."""

    def __init__(self, codes: np.ndarray, most: int):
        self.codes = codes.tolist()

    def _count(self, i: int, j: int, step: int) -> int:
        n = 0
        while 0 <= i and j < len(self.codes) and self.codes[i] == self.codes[j]:
            i, j, n = i + step, j + step, n + 1
        return n

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.fromiter((self._count(a, b, 1) for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.fromiter((self._count(a - 1, b - 1, -1) for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))


def _middles(left: np.ndarray, right: np.ndarray, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(middle, period) of all parts, about ``PAIRS`` at a time; a longer list of one part's periods is cut."""
    middle, most = (left + right) // 2, (right - left) // power
    ends = np.cumsum(most)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
        part = np.searchsorted(ends, pair, side="right")
        yield middle[part], pair - (ends - most)[part] + 1


def crossing(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, power: int, kind: type = Extensions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the stretches ``codes[begin:end]``; a code of its own follows every stretch."""
    found = [np.zeros((3, 0), np.int64)]
    longer = kind(codes, int((end - begin).max(initial=1)))
    half = least_overlap(least, power) // 2
    grams = np.zeros(len(codes) + half, np.uint64)
    grams[: max(0, len(codes) - half + 1)] = gram_hashes(mix(codes.astype(np.uint64)), half)
    left, right = begin, end
    while len(left := left[(big := right - left >= least)]):
        right = right[big]
        for middle, period in _middles(left, right, power):
            for i in (middle, middle - period):
                # A run is the same half an overlap ahead of this place or behind it.
                near = grams[i] == grams[i + period]
                near |= (i >= half) & (grams[np.maximum(i - half, 0)] == grams[np.maximum(i - half, 0) + period])
                at, q = i[near], period[near]
                back = longer.behind(at, at + q)
                length = back + longer.ahead(at, at + q) + q
                good = length >= np.maximum(least, power * q)
                found.append(np.stack((at - back, length, q))[:, good])
        middle = (left + right) // 2
        left, right = np.concatenate((left, middle)), np.concatenate((middle, right))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # Multiples of a run's period have its bounds.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def periodic(codes: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether every run is one, word by word, and no neighbour extends it."""
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        if not np.array_equal(codes[s : s + n - q], codes[s + q : s + n]) or s and codes[s - 1] == codes[s - 1 + q] or s + n < len(codes) and codes[s + n] == codes[s + n - q]:
            return False
    return True


def runs_of(words: Words, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of a block, by row, start and period; ``start`` is a word number of the row."""
    none = np.zeros(0, np.int64)
    begin, end = stretches(surviving(words.hashes(), words.first, least_overlap(least, power)), words.first, least) if len(words) else (none, none)
    if not len(begin):
        return none, none, none, none
    # The words of each stretch by exact codes, then a code of its own.
    names: dict[bytes, int] = {}
    raw, codes, cut = words.data.tobytes(), [], np.zeros(len(begin), np.int64)
    for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        cut[k] = len(codes)
        codes += [names.setdefault(raw[x:y], len(names)) for x, y in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]
        codes.append(-1 - k)
    codes = np.array(codes, np.int64)
    found = crossing(codes, cut, cut + end - begin, least, power)
    if not periodic(codes, *found):
        found = crossing(codes, cut, cut + end - begin, least, power, Compared)
    start, length, period = found
    part = np.searchsorted(cut, start, side="right") - 1
    row = row_of(words.first)[begin][part]
    start = start - cut[part] + begin[part] - words.first[row]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


def collapse(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, power: int = POWER) -> DataFrame:
    """key, n_words, runs (array of start, length, period) and collapsed of every row: the text with each run cut to its first period.

    A run is a stretch of words with smallest period q, of ``least`` words and ``power`` periods or more, that neither neighbour
    extends. A word goes if any run has it after that run's first q words; the others are joined by one space. Null and empty texts
    have no words, no runs and an empty collapsed text. Null and repeated keys are rows like any other; other columns are ignored. A
    row is worked on whole, in one task.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, 1):
                words = Words(*text_bytes(batch.column(1).slice(a, b - a)))
                row, start, length, period = runs_of(words, least, power)
                # Steps up and down at the ends of what is dropped; runs overlap.
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, words.first[row] + start + period, 1)
                np.subtract.at(steps, words.first[row] + start + length, 1)
                keep = np.cumsum(steps[:-1]) == 0
                joined, starts, ends = join_words(words, np.flatnonzero(keep))
                kept = np.concatenate(([0], np.cumsum(keep)))[words.first]
                raw = joined.tobytes()
                texts = [raw[starts[x] : ends[y - 1]] if y > x else b"" for x, y in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
                parts = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts().astype(np.int64)), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("key", key)


def longest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)  # noqa: E731  runs come by start and period
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def planted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with periodic words from some word on in those rows whose key's crc32 is divisible by ten; such texts have one space between words."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.crc32(F.col(key).cast("string"))
    rows = docs.select(F.col(key), F.col(text), F.floor(hashed / 10).alias("__g"), F.when(hashed % 10 == 0, words).alias("__words"))
    n, g = F.size("__words"), F.col("__g")
    rows = rows.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", 1 + F.floor((n - F.col("__a")) / (3 + g % 8)))
    a, p = F.col("__a"), F.col("__p")
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("__words")[F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")])
    return rows.select(F.col(key), F.when(n > 0, F.concat_ws(" ", same)).otherwise(F.col(text)).alias(text))
