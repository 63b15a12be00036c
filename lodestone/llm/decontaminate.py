"""Benchmark decontamination by a prefix-filtered set join.

Every window of benchmark words is a set of words ordered by rarity in the documents. For exact
containment the necessary prefix is its rarest word alone, so only places of those words in a document are
candidates. The word's place in the window gives the one alignment to test (positional bound), which
must lie inside the document (length bound); what is left is verified word by word.

1. The benchmark is exploded once into a table of its distinct windows, whatever its size.
2. One scan of the documents counts the benchmark's words; each window takes its rarest word as prefix.
3. One scan finds the places of prefix words and the windows around them that pass the bounds. Two bitmaps of fixed size
   (``FILTER_BITS``), of prefix words and of windows with their prefix's place, spare the scan nearly all candidates in vain.
4. Candidates join the windows in Spark on their words, which verifies them; hits and items are gathered by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Words, blocks, gram_hashes, join_words, mix, row_of, ship, stored, text_bytes
from .simhash import join_heavy

WINDOW = 10
#: log2 of the bits of a bitmap: 8 MB each, collected as at most 2**20 rows of 64 bits.
FILTER_BITS = 26
#: Bytes of windows up to which ``clean`` verifies candidates where it finds them; beyond, they are joined.
LOCAL_BYTES = 8 << 20
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z and all beyond ASCII.
ITEM_WORD = np.zeros(256, bool)
ITEM_WORD[0x30:0x3A] = ITEM_WORD[0x61:0x7B] = ITEM_WORD[0x80:] = True


def item_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(LOWER[data], offsets, ITEM_WORD)


def _marks(window: int) -> np.ndarray:
    """What a prefix word's place in its window adds to the window's hash."""
    return mix(np.arange(1, window + 1, dtype=np.uint64))


def _window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    return mix(gram_hashes(hashes, size) + np.uint64(size))


def windows_of(benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """(gram, item, size, hash, words) of every window of every item: words joined by a space, the item as a string, the words' hashes."""
    ship(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, 1, 1 << 18):
                words = item_words(*text_bytes(batch.column(1).slice(a, b - a)))
                hashes, counts = words.hashes(), words.counts()
                joined, starts, ends = join_words(words)
                raw, names = joined.tobytes(), batch.column(0).slice(a, b - a).to_pylist()
                out: list[list] = [[], [], [], [], []]
                for row in np.flatnonzero(counts).tolist():
                    size = int(min(window, counts[row]))
                    at = np.arange(words.first[row], words.first[row + 1] - size + 1)
                    found = _window_hashes(hashes[words.first[row] : words.first[row + 1]], size).view(np.int64)
                    out[0] += [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[at].tolist(), ends[at + size - 1].tolist(), strict=True)]
                    out[1] += [names[row]] * len(at)
                    out[2] += [size] * len(at)
                    out[3] += found.tolist()
                    out[4] += [hashes[x : x + size].view(np.int64).tolist() for x in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["gram", "item", "size", "hash", "words"])

    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(run, "gram string, item string, size int, hash long, words array<long>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits, by their highest ``FILTER_BITS`` bits, of a one-column table of hashes."""
    name = hashes.columns[0]
    place = F.shiftrightunsigned(name, 64 - FILTER_BITS)
    found = hashes.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{name}`, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    rows = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**(FILTER_BITS - 6) rows
    out = np.zeros(1 << max(0, FILTER_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(65 - (len(bits) * 64).bit_length())
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequencies(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(word, n): how often the words of a bitmap occur in all documents (one text column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for a, b in blocks(batch, 0):
                hashes = item_words(*text_bytes(batch.column(0).slice(a, b - a))).hashes()
                found.append(hashes[_in(vocabulary.value, hashes)])
            word, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Candidates:
    """Finds the windows of a text that the bitmaps let through."""

    def __init__(self, prefixes: np.ndarray, bits: np.ndarray, sizes: list[int], window: int):
        self.prefixes, self.bits, self.sizes, self.window = prefixes, bits, sizes, window

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, size, offset of the prefix word) of the candidates, starts counted over all rows."""
        hashes = words.hashes()
        places = np.flatnonzero(_in(self.prefixes, hashes)) if len(hashes) else np.zeros(0, np.int64)
        row, marks, out = row_of(words.first)[places], _marks(self.window), [(np.zeros(0, np.int64),) * 4]
        for size in self.sizes if len(places) else ():
            grams = _window_hashes(hashes, size)
            for offset in range(size):
                start = places - offset
                good = np.flatnonzero((start >= words.first[row]) & (start + size <= words.first[row + 1]))
                good = good[_in(self.bits, grams[start[good]] ^ marks[offset])]
                out.append((row[good], start[good], np.full(len(good), size), np.full(len(good), offset)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gram_texts(words: Words, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    raw, starts, ends = words.data, words.starts, words.ends
    return [b" ".join(raw[x:y].tobytes() for x, y in zip(starts[s : s + n].tolist(), ends[s : s + n].tolist(), strict=True)) for s, n in zip(start.tolist(), size.tolist(), strict=True)]


def prepared(docs: DataFrame, benchmark: DataFrame, window: int, text: str) -> tuple[DataFrame, DataFrame, Candidates]:
    """Of documents (one text column) and a benchmark: its windows with their items, its distinct windows (gram, offset of the prefix), and the finder."""
    spark = docs.sparkSession
    exploded = stored(windows_of(benchmark, window, text))
    distinct = stored(exploded.groupBy("gram").agg(F.first("size").alias("size"), F.first("hash").alias("hash"), F.first("words").alias("words")))
    words = distinct.select("gram", "size", "hash", F.posexplode("words").alias("offset", "word"))
    counts = frequencies(docs, spark.sparkContext.broadcast(bitmap(words.select("word"))))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "word")).alias("prefix")
    marks = F.array(*(F.lit(int(m)) for m in _marks(window).view(np.int64)))
    chosen = words.join(counts, "word", "left").groupBy("gram", "size", "hash").agg(rarest)
    chosen = stored(chosen.select("gram", "size", F.col("prefix.offset").alias("offset"), F.col("prefix.word").alias("prefix"), F.col("hash").bitwiseXOR(F.get(marks, F.col("prefix.offset"))).alias("mark")))
    sizes = [r["size"] for r in chosen.select("size").distinct().orderBy("size").collect()]  # at most ``window``
    return exploded, chosen, Candidates(bitmap(chosen.select("prefix")), bitmap(chosen.select("mark")), sizes, window)


def detect(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, n_words, hit (places of words inside a window's occurrence), items (their ids as sorted strings).

    Null and empty texts have no words; items without words have no windows; items with equal texts all
    count. Repeated rows and keys are each answered. A null item_id reads ``None``. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    exploded, chosen, finder = prepared(rows.select("text"), benchmark, window, text)
    shared = spark.sparkContext.broadcast(finder)  # two bitmaps of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, 1):
                words = item_words(*text_bytes(batch.column(1).slice(a, b - a)))
                row, start, size, offset = shared.value.find(words)
                grams = _gram_texts(words, start, size)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for r, s, n, o, g in zip(row.tolist(), (start - words.first[row]).tolist(), size.tolist(), offset.tolist(), grams, strict=True):
                    found[r].append({"start": s, "size": n, "offset": o, "gram": g.decode("utf-8", "replace")})
                kinds = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("offset", pa.int32()), ("gram", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts(), pa.int64()), pa.array(found, kinds)], names=["key", "n_words", "found"])

    scanned = rows.mapInArrow(run, f"key {kind}, n_words long, found array<struct<start: int, size: int, offset: int, gram: string>>")
    scanned = stored(scanned.withColumn("id", F.monotonically_increasing_id()))
    candidates = scanned.select("id", F.explode("found").alias("c")).select("id", "c.*")
    grams = candidates.groupBy("gram", "offset").agg(F.count("*").alias("n")).join(chosen.select("gram", "offset"), ["gram", "offset"])
    verified = stored(join_heavy(candidates, stored(grams.select(F.struct("gram", "offset").alias("window"), "n")), "window", int(candidates.count()), F.struct("gram", "offset")))
    places = verified.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + size - 1)"))))).alias("hit"))
    of_gram = verified.groupBy(F.col("window.gram").alias("gram")).agg(F.count("*").alias("n"))
    by_item = exploded.select("gram", "item").distinct().join(of_gram.filter(F.col("n") > 0), "gram").groupBy("gram").agg(F.collect_set("item").alias("items"), F.first("n").alias("n"))
    told = join_heavy(verified.select("id", F.col("window.gram").alias("gram")).distinct(), stored(by_item), "gram", verified.count())
    items = told.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = scanned.select("key", "n_words", "id").join(places, "id", "left").join(items, "id", "left")
    return joined.select(F.col("key").alias(key), "n_words", *(F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in (("hit", "int"), ("items", "string"))))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark window occurs in; null and empty texts stay.

    Up to ``LOCAL_BYTES`` of windows, candidates are verified where they are found and no text is moved; beyond that, they are
    joined with the windows, and the texts found to be hit are joined out.
    """
    spark = docs.sparkSession
    ship(spark)
    column = docs.columns.index(text)
    _, chosen, finder = prepared(docs.select(F.col(text).alias("text")), benchmark, window, text)
    local = (chosen.agg(F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()[0]) <= LOCAL_BYTES
    grams = {(r["gram"].encode(), r["offset"]) for r in chosen.select("gram", "offset").collect()} if local else None  # LOCAL_BYTES at most
    shared = spark.sparkContext.broadcast((finder, grams))

    def candidates(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        words = item_words(*text_bytes(part.column(at)))
        row, start, size, offset = shared.value[0].find(words)
        return row, offset, _gram_texts(words, start, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[1]
        for batch in batches:
            for a, b in blocks(batch, column):
                part, keep = batch.slice(a, b - a), np.ones(b - a, bool)
                for r, o, g in zip(*candidates(part, column), strict=True):
                    if (g, int(o)) in known:
                        keep[r] = False
                yield part.filter(pa.array(keep))

    if local:
        return docs.mapInArrow(run, T.StructType(docs.schema.fields))
    digest = F.unhex(F.sha2(F.col(text), 256))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, 1):
                part = batch.slice(a, b - a)
                row, offset, found = candidates(part, 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(offset, pa.int32()), pa.array([g.decode("utf-8", "replace") for g in found], pa.string())], names=["digest", "offset", "gram"])

    # Copies of a text are one candidate: the verdict is the text's.
    asked = docs.select(digest.alias("digest"), F.col(text).alias("text")).mapInArrow(sent, "digest binary, offset int, gram string").distinct()
    hit = stored(asked.join(chosen.select("gram", "offset"), ["gram", "offset"]).select(F.col("digest").alias("__lodestone_digest")).distinct())
    return docs.join(hit, digest == F.col("__lodestone_digest"), "left_anti")
