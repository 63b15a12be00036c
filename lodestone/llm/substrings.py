"""Substring dedup by Relative Lempel-Ziv parsing of documents against indexed reference blocks.

Documents are dealt into blocks and stored once, bucketed by block. Reference blocks are cut by content, not by document:

1. Anchors. Every window of 13 words has an anchor, the least hash of its 5-word sequences; equal windows have equal
   anchors. Blocks say which anchors they hold, and are told those that more than one document has.
2. Segments. A run of windows with one such anchor, as words, goes to the reference block of its anchor, the only one that can
   hold its windows. A block sends equal segments once. An anchor of many documents has a reference block for each of its windows.
3. Parsing. A reference block indexes its segments by window and parses each of them greedily against those of smaller
   documents: the factor that begins at a window grows word by word in its source. Then the windows across the factor's
   end are looked up, and the first that is found begins the next factor. Factors have 13 words or more.
4. Spans. The factors go back to their documents' blocks, and the words that they cover are removed.

Hashes only choose candidates: windows and factors are compared as words. No step sends a row for a pair of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, blocks, gram_hashes, input_bytes, join_words, mix, row_of, ship, text_bytes, within_rows

WINDOW, ANCHOR = 13, 5
#: Stored bytes of a block, which a task holds at once, and the most buckets that blocks are stored in.
BLOCK_SIZE, BUCKETS = 4 << 20, 50_000
#: Windows of a segment at most.
RUN = 64
#: Documents of an anchor beyond which its windows are sent one by one: so many segments may differ in one reference block.
HOT = 256
_LAST = (1 << 63) - 1
_tables: list[str] = []


def _runs(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first window, number of windows, anchor) of runs of windows that follow each other with one anchor."""
    at, size = within_rows(words.first, window), min(ANCHOR, window)
    grams, span = gram_hashes(words.hashes(), size), window - size + 1
    if len(grams) < span or not len(at):
        return at[:0], at[:0], np.zeros(0, np.uint64)
    # Sliding minimum by doubling.
    least, width = grams, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(grams) - span + 1
    anchors = np.minimum(least[:n], least[span - width : span - width + n])[at]
    row = row_of(words.first)[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    begun = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - begun) % RUN == 0
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), anchors[first]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (rank, key, text) with how often each is in its batch, so that one row repeated very often stays small."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["rank", "key", "text"], use_threads=False).aggregate([([], "count_all")])
        yield from table.rename_columns(["rank", "key", "text", "copies"]).select(["rank", "key", "text", "copies"]).to_batches()


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, anchor, documents) of each batch of (block, text)."""
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), [(np.zeros(0, np.int32), np.zeros(0, np.uint64))]
            for a, b in blocks(batch, 1):
                words = Words(*text_bytes(batch.column(1).slice(a, b - a)))
                begin, _, anchors = _runs(words, window)
                row = row_of(words.first)[begin]
                order = np.lexsort((anchors, row))
                row, anchors = row[order], anchors[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchors[1:] != anchors[:-1])
                found.append((ids[a:b][row[new]], anchors[new]))
            ids, anchors = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, anchors))
            ids, anchors = ids[order], anchors[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (anchors[1:] != anchors[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int32()), pa.array(anchors[first].view(np.int64)), pa.array(n, pa.int64())], names=["block", "anchor", "documents"])

    return run


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


_SEGMENTS = "key long, rank long, block int, slots binary, starts binary, ends binary, sources binary, text binary"
_FACTORS = "block int, slots binary, starts binary, ends binary, sources binary"


def _merged(slot: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one slot and source that overlap, as one."""
    order = np.lexsort((start, source, slot))
    slot, start, end, source = slot[order], start[order], end[order], source[order]
    if not len(slot):
        return slot, start, end, source
    other = np.ones(len(slot), bool)
    other[1:] = (slot[1:] != slot[:-1]) | (source[1:] != source[:-1])
    # Ends so far within a slot and source: groups are told apart by an offset beyond any end.
    wide = np.cumsum(other) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + wide)
    new = other.copy()
    new[1:] |= start[1:] + wide[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return slot[first], start[first], np.maximum.reduceat(end, first), source[first]


def _segments(window: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The segments of a block with shared anchors, and the factors that it finds among its own."""
        told = answers["anchor"].to_numpy().view(np.uint64)
        order = np.argsort(told)
        shared, hot = told[order], answers["hot"].to_numpy(zero_copy_only=False)[order]
        numbers: dict[bytes, int] = {}
        keys: list[int] = []
        found = [(np.zeros(0, np.int64),) * 5]
        for batch in texts.to_batches():
            ranks, slots = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in blocks(batch, 3):
                words = Words(*text_bytes(batch.column(3).slice(a, b - a)))
                begin, n, anchors = _runs(words, window)
                good = _member(anchors, shared)
                begin, n, anchors = begin[good], n[good], anchors[good]
                if not len(begin):
                    continue
                single = hot[np.searchsorted(shared, anchors)]
                # A hot anchor's windows go one by one, to a reference block of their own.
                whole, alone = ~single, np.repeat(begin[single] - np.cumsum(n[single]) + n[single], n[single]) + np.arange(int(n[single].sum()))
                key = np.concatenate((anchors[whole], mix(gram_hashes(words.hashes(), window)[alone]))).view(np.int64).tolist()
                begin, n = np.concatenate((begin[whole], alone)), np.concatenate((n[whole], np.ones(len(alone), np.int64)))
                joined, starts, ends = join_words(words)
                raw, number = joined.tobytes(), np.empty(len(begin), np.int64)
                for i, (x, y, k) in enumerate(zip(starts[begin].tolist(), ends[begin + n + window - 2].tolist(), key, strict=True)):
                    segment = raw[x:y]
                    at = numbers.get(segment)
                    if at is None:
                        at = numbers[segment] = len(keys)
                        keys.append(k)
                    number[i] = at
                row = row_of(words.first)[begin]
                at = begin - words.first[row]
                found.append((number, ranks[a:b][row], slots[a:b][row], at, at + n + window - 1))
        number, rank, slot, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank, number))
        number, rank, slot, start, end = number[order], rank[order], slot[order], start[order], end[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        least = np.repeat(rank[first], np.diff(np.append(first, len(number)))) if len(first) else rank
        later = rank > least
        own = [x.astype(t).tobytes() for x, t in zip(_merged(slot[later], start[later], end[later], least[later]), ("i8", "i4", "i4", "i8"), strict=True)]
        mine = ~later
        slot, start, number, rank = slot[mine], start[mine], number[mine], rank[mine]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        after = np.append(first[1:], len(number))[: len(first)]
        slot, start = slot.astype("i8"), start.astype("i4")
        names = list(numbers)
        block = texts["block"][0].as_py() if texts.num_rows else 0
        n = len(first)
        cut = lambda v: pa.array([*(v[x:y].tobytes() for x, y in zip(first.tolist(), after.tolist(), strict=True))], pa.binary())
        none = pa.nulls(n, pa.binary())
        sent = pa.table({"key": pa.array([keys[i] for i in number[first].tolist()], pa.int64()), "rank": pa.array(rank[first]), "block": pa.array(np.full(n, block, np.int32)), "slots": cut(slot), "starts": cut(start), "ends": none, "sources": none, "text": pa.array([names[i] for i in number[first].tolist()], pa.binary())})
        if not later.any():
            return sent
        spread = int(mix(np.array([block], np.uint64)).view(np.int64)[0])
        kept = pa.table({"key": pa.array([spread]), "rank": pa.array([0]), "block": pa.array([block], pa.int32()), "slots": [own[0]], "starts": [own[1]], "ends": [own[2]], "sources": [own[3]], "text": pa.nulls(1, pa.binary())})
        return pa.concat_tables([sent, kept.cast(sent.schema)])

    return run


def factors(words: list[bytes], index: dict[bytes, tuple[int, list[bytes], int]], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, end, source) of the greedy parse of ``words`` against an index of window to (source, its words, place)."""
    out, at, n = [], 0, len(words)
    while at <= n - window:
        hit = index.get(b" ".join(words[at : at + window]))
        if hit is None:
            at += 1
            continue
        source, theirs, place = hit
        end, place = at + window, place + window
        while end < n and place < len(theirs) and words[end] == theirs[place]:
            end, place = end + 1, place + 1
        out.append((at, end, source))
        at = end - window + 1  # the first window across the factor's end
    return out


def parse_group(members: list[tuple[int, bytes]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Factors of the segments (rank, words joined by a space; ranks ascending) of a reference block, each parsed against those of smaller ranks."""
    least = members[0][0]
    if all(text == members[0][1] for _, text in members[1:]):
        whole = [(0, members[0][1].count(b" ") + 1, least)]
        return [whole if rank > least else [] for rank, _ in members]
    index: dict[bytes, tuple[int, list[bytes], int]] = {}
    out, at = [], 0
    while at < len(members):
        rank, equal = members[at][0], []
        while at < len(members) and members[at][0] == rank:  # equal ranks take nothing from each other
            words = members[at][1].split(b" ")
            out.append(factors(words, index, window))
            equal.append(words)
            at += 1
        for words in equal:
            for place in range(len(words) - window + 1):
                index.setdefault(b" ".join(words[place : place + window]), (rank, words, place))
    return out


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Factors of segments that arrive in order of their keys; a key may go over several batches."""
        held: list[pa.RecordBatch] = []

        def parsed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            own = table.filter(pa.compute.is_null(table["text"]))
            yield from own.select(["block", "slots", "starts", "ends", "sources"]).to_batches()
            table = table.filter(pa.compute.is_valid(table["text"]))
            if not table.num_rows:
                return
            keys, ranks, block = table["key"].to_numpy(), table["rank"].to_numpy(), table["block"].to_numpy()
            order = np.lexsort((ranks, keys))
            first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1))
            text, slots, starts = (table[c].combine_chunks() for c in ("text", "slots", "starts"))
            out: dict[int, list[tuple[np.ndarray, ...]]] = {}
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                if b - a < 2:
                    continue
                which = order[a:b].tolist()
                members = [(r, text[i].as_py()) for r, i in zip(ranks[order[a:b]].tolist(), which, strict=True)]
                for i, spans in zip(which, parse_group(members, window), strict=True):
                    if spans:
                        slot, at = np.frombuffer(slots[i].as_py(), "i8"), np.frombuffer(starts[i].as_py(), "i4")
                        for start, end, source in spans:
                            out.setdefault(int(block[i]), []).append((slot, at + start, at + end, np.full(len(slot), source)))
            if out:
                merged = {k: _merged(*(np.concatenate(x) for x in zip(*v, strict=True))) for k, v in out.items()}
                columns = [pa.array([v[i].astype(t).tobytes() for v in merged.values()], pa.binary()) for i, t in enumerate(("i8", "i4", "i4", "i8"))]
                yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), *columns], names=["block", "slots", "starts", "ends", "sources"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if not whole and (not held or held[0].column(0)[0].as_py() == keys[-1]):
                held.append(batch)
                continue
            yield from parsed(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held = [batch.slice(whole)]
        if held:
            yield from parsed(pa.Table.from_batches(held))

    return run


def _removed(window: int):
    names = ["key", "n_words", "n_removed", "kept", "factors"]
    factor = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        slot, start, end, source = (np.frombuffer(b"".join(answers[c].to_pylist()), t).astype(np.int64) for c, t in (("slots", "i8"), ("starts", "i4"), ("ends", "i4"), ("sources", "i8")))
        slot, start, end, source = _merged(slot, start, end, source)
        out = []
        for batch in texts.to_batches():
            slots, copies = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            for a, b in blocks(batch, 3):
                words = Words(*text_bytes(batch.column(3).slice(a, b - a)))
                mine = slots[a:b]
                order = np.argsort(mine)
                at = np.minimum(np.searchsorted(mine[order], slot), b - a - 1)
                hit = np.flatnonzero(mine[order][at] == slot)
                row = order[at[hit]]
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, words.first[row] + start[hit], 1)
                np.add.at(steps, words.first[row] + end[hit], -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed = np.concatenate(([0], np.cumsum(gone)))[words.first]
                joined, _, ends = join_words(words, ~gone)
                text_ends = np.concatenate(([0], ends + 1))[words.first - removed]
                raw = joined.tobytes()
                kept = [raw[x : max(x, y - 1)] for x, y in zip(text_ends[:-1].tolist(), text_ends[1:].tolist(), strict=True)]
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                for r, s, e, k in zip(row.tolist(), start[hit].tolist(), end[hit].tolist(), source[hit].tolist(), strict=True):
                    spans[r].append({"start": s, "end": e, "source": k})
                done = pa.table([batch.column(4).slice(a, b - a), pa.array(words.counts(), pa.int64()), pa.array(np.diff(removed)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(factor))], names=names)
                n = copies[a:b]
                out.append(done.take(np.repeat(np.arange(b - a), n)) if (n > 1).any() else done)
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(factor)), strict=True)})

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, n_words, n_removed, kept (words left, one space between) and factors (start, end, source).

    A word goes if it lies in a window of ``window`` words whose sequence also starts in a row with a smaller key;
    all windows are those of the input. The key is an integer (anything else is refused). Null and empty texts have no
    words. A null key counts as the largest, so such rows give nothing to others with keys; rows with equal keys
    take nothing from each other. Other columns are ignored. The stored blocks stay until ``forget``.
    """
    spark = docs.sparkSession
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be an integer column: smaller keys are originals")
    ship(spark)
    n = max(8, -(-input_bytes(docs, text) // BLOCK_SIZE))
    buckets = min(BUCKETS, -(-n // 4))  # several small blocks a bucket even out what a task reads
    rank = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    rows = docs.select(rank.alias("rank"), F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_collapse, "rank long, key long, text string, copies long")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rank", "text"), F.lit(n)).cast("int")).repartition(buckets, "block")
    name = f"lodestone_blocks_{uuid.uuid4().hex}"
    dealt.select("block", "rank", F.monotonically_increasing_id().alias("slot"), "text", "key", "copies").write.option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    _tables.append(name)
    table = spark.table(name)
    held = table.select("block", "text").mapInArrow(_anchor_rows(window), "block int, anchor long, documents long")
    same = Window.partitionBy("anchor")
    counted = held.withColumn("documents", F.sum("documents").over(same)).withColumn("hot", F.col("documents") > HOT)
    shared = counted.filter("documents > 1").select("block", "anchor", "hot")
    segments = table.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_segments(window), _SEGMENTS)
    found = segments.repartition("key").sortWithinPartitions("key").mapInArrow(_parse(window), _FACTORS)
    parsed = table.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_removed(window), "key long, n_words long, n_removed long, kept string, factors array<struct<start: long, end: long, source: long>>")
    return parsed.withColumnRenamed("key", key)


def forget(spark: SparkSession) -> None:
    """Drop the blocks that earlier calls stored; what was not yet computed from them is lost."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
