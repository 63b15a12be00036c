"""Entities and relations taken from text, and graph expansion as bounded rounds of joins."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import map_batches, numbered, stored
from . import relational


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of (a, b) edges as distinct (node, other)."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()


def expand(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of everything within ``depth`` steps of the seeds, at its least depth."""
    links = neighbours(edges)
    found = level = seeds.select("node", F.lit(0).cast("long").alias("depth")).distinct()
    for n in range(1, depth + 1):
        level = links.join(level.select("node"), "node").select(F.col("other").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.lit(n).cast("long").alias("depth"))
        found = found.unionByName(level)
    return found


#: The relation of a chunk's first two entities, and its confidence.
RELATED, RELATED_CONFIDENCE = "related_to", 0.7
#: Characters by which terms and names are joined before they are compared.
GRAM = 3
#: Bytes of what a block of queries reaches, the fewest blocks, links or mentions in a row, and links or chunks that a task takes at once.
STATE_BYTES, BLOCKS, ROW, AT_ONCE = 64 << 20, 16, 1 << 16, 2048


def extracted(chunks: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, float]], entities: int = 20) -> DataFrame:
    """(key, found): each chunk's first ``entities`` mentions, ARRAY<STRUCT<name, normalized, type, confidence>>, pattern by pattern and in order of the text.

    ``patterns`` gives a regular expression and a confidence for each type. Null and empty texts have none.
    """
    def of(kind: str, pattern: str, confidence: float) -> Column:
        value = lambda m: F.struct(F.trim(m).alias("name"), F.lower(F.trim(m)).alias("normalized"), F.lit(kind).alias("type"), F.lit(float(confidence)).alias("confidence"))
        return F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), value)

    lists = [of(kind, p, c) for kind, (p, c) in patterns.items()]
    return chunks.select(F.col(key), F.slice(F.concat(*lists), 1, entities).alias("found"))


def graph_of(found: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, nodes, edges) of ``extracted`` chunks.

    ``mentions`` has key and normalized, each pair once; ``nodes`` normalized, name, type and confidence of the best mention (ties: the first name, then type); ``edges`` a, b, confidence and
    n_found of the relations of chunks with two mentions or more: the first mention's entity to the second's, its greatest confidence and how often it was found.
    """
    each = found.select(key, F.explode("found").alias("m"))
    mentions = each.select(key, F.col("m.normalized").alias("normalized")).distinct()
    worth = F.struct((-F.col("m.confidence")).alias("worth"), F.col("m.name").alias("name"), F.col("m.type").alias("type"))
    nodes = each.groupBy(F.col("m.normalized").alias("normalized")).agg(F.min(worth).alias("best")).select("normalized", "best.name", "best.type", (-F.col("best.worth")).alias("confidence"))
    pairs = found.filter(F.size("found") >= 2).select(F.get("found", F.lit(0))["normalized"].alias("source"), F.lit(RELATED).alias("type"), F.get("found", F.lit(1))["normalized"].alias("target"), F.lit(RELATED_CONFIDENCE).alias("confidence"))
    edges = relational.best_relations(pairs).select(F.col("source").alias("a"), F.col("target").alias("b"), "confidence", "n_found")
    return mentions, nodes, edges


def named_like(nodes: DataFrame, terms: DataFrame, query: str) -> DataFrame:
    """(query, node) of the entities whose normalized name contains a term of a query; ``terms`` has query and term, terms shorter than three characters find nothing.

    Names are joined with terms by three characters in a row before they are compared, so no term meets every name.
    """
    grams = nodes.filter(F.length("normalized") >= GRAM).select("normalized", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("normalized") - GRAM + 1), lambda i: F.substring("normalized", i, F.lit(GRAM))))).alias("gram"))
    asked = terms.filter(F.length("term") >= GRAM).select(query, F.lower("term").alias("term")).distinct()
    wanted = asked.select("term", F.substring("term", 1, GRAM).alias("gram")).distinct()  # a term of many queries is compared once
    met = grams.join(wanted, "gram").filter(F.contains("normalized", F.col("term"))).select("term", F.col("normalized").alias("node")).distinct()
    return asked.join(met, "term").select(query, "node").distinct()


def reached(edges: DataFrame, starts: DataFrame, query: str, depth: int) -> DataFrame:
    """(query, node) of everything within ``depth`` steps of each query's ``starts`` (query, node), in either direction: one join a step."""
    links = neighbours(edges)
    found = level = starts.select(query, "node").distinct()
    for _ in range(depth):
        level = level.join(links, "node").select(query, F.col("other").alias("node")).distinct().join(found, [query, "node"], "left_anti")
        found = found.unionByName(level)
    return found


def expanded_chunks(mentions: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, terms: DataFrame, query: str, key: str, depth: int, scope: DataFrame | None = None) -> DataFrame:
    """(query, key, score): the chunks that mention what a query reaches, by how many entities of it they mention; its seeds are left out.

    A query starts from the entities that its ``seeds`` (query, key) mention and from those named like its ``terms`` (query, term). A ``scope`` of None restricts nothing, an empty one gives nothing.
    """
    mine = seeds.join(mentions, key).select(query, F.col("normalized").alias("node"))
    near = reached(edges, mine.unionByName(named_like(nodes, terms, query)), query, depth)
    rows = near.join(mentions.withColumnRenamed("normalized", "node"), "node").groupBy(query, key).agg(F.count("*").alias("score"))
    rows = rows.join(seeds.select(query, key).distinct(), [query, key], "left_anti")
    return rows if scope is None else rows.join(scope.select(key).distinct(), key, "left_semi")


def _in_rows(chunks: DataFrame) -> DataFrame:
    """(first, keys, sizes, numbers) of chunks (key, numbers) in order of their keys, about ``ROW`` numbers a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, at = batch.column("key"), batch.column("numbers"), 0
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROW, side="right")))
                mine, held = keys.slice(at, stop - at), lists.slice(at, stop - at)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([mine.slice(0, 1), one(mine), one(held.value_lengths().cast(pa.int32())), one(held.flatten())], names=["first", "keys", "sizes", "numbers"])
                at = stop

    kind = chunks.schema["key"].dataType.simpleString()
    return map_batches(chunks, run, f"first {kind}, keys array<{kind}>, sizes array<int>, numbers array<int>")


class _Reach:
    """What a block of queries reaches, a bit for each node and query, and the best chunks of each query so far."""

    def __init__(self, nodes: int, words: int, k: int):
        self.bits, self.before, self.level, self.k = np.zeros((nodes, words), np.uint64), None, 0, k
        self.own: dict = defaultdict(list)
        self.least, self.met, self.step = np.zeros(64 * words, np.int64), 0, 64
        self.slot, self.score, self.at, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def start(self, slots: np.ndarray, nodes: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, (nodes, slots // 64), np.uint64(1) << (slots % 64).astype(np.uint64))

    def go(self, level: int, nodes: np.ndarray, others: np.ndarray) -> None:
        """Some links of a step; what a step adds counts from the next one."""
        if level != self.level:
            self.before, self.level = self.bits.copy(), level
        order = np.argsort(others, kind="stable")
        nodes, others = nodes[order], others[order]
        for i in range(0, len(nodes), AT_ONCE):
            to = others[i : i + AT_ONCE]
            starts = np.flatnonzero(np.diff(to, prepend=-1))
            self.bits[to[starts]] |= np.bitwise_or.reduceat(self.before[nodes[i : i + AT_ONCE]], starts, axis=0)

    def chunks(self, keys: pa.Array, sizes: np.ndarray, nodes: np.ndarray) -> None:
        """Chunks in order of their keys, so one that comes later has to have a greater score than the ``k`` of before."""
        ends, i = np.cumsum(sizes), 0
        mine = np.flatnonzero(pc.is_in(keys, pa.array(list(self.own), keys.type)).to_numpy(zero_copy_only=False)) if self.own else ()
        own = {int(x): self.own[keys[int(x)].as_py()] for x in mine}
        while i < len(keys):
            j = min(i + self.step, len(keys))
            self._some(keys, sizes[i:j], (ends - sizes)[i:j], nodes, i, [(x - i, slot) for x, slots in own.items() if i <= x < j for slot in slots])
            i, self.step = j, min(2 * self.step, AT_ONCE)
        self.met += len(keys)

    def _some(self, keys: pa.Array, sizes: np.ndarray, starts: np.ndarray, nodes: np.ndarray, first: int, own: list[tuple[int, int]]) -> None:
        order = np.argsort(-sizes, kind="stable")
        sizes, starts, most = sizes[order], starts[order], int(sizes.max())
        planes = np.zeros((most.bit_length(), len(order), self.bits.shape[1]), np.uint64)  # counts of 64 queries at once, a plane for each of their bits
        for n in range(most):
            some = int(np.count_nonzero(sizes > n))
            carry = self.bits[nodes[starts[:some] + n]]
            for plane in planes[: (n + 1).bit_length(), :some]:
                both = plane & carry
                plane ^= carry
                carry = both
        more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
        for p in reversed(range(max(len(planes), int(self.least.max()).bit_length()))):
            limit = np.packbits((self.least >> p) & 1 == 1, bitorder="little").view(np.uint64)
            plane = planes[p] if p < len(planes) else np.zeros_like(more)
            more |= same & plane & ~limit
            same &= ~(plane ^ limit)
        place = np.argsort(order)
        for x, slot in own:
            more[place[x], slot // 64] &= ~(np.uint64(1) << np.uint64(slot % 64))
        rows = np.flatnonzero(more.any(axis=1))
        if not len(rows):
            return
        row, slot = np.nonzero(np.unpackbits(more[rows].view(np.uint8), axis=1, bitorder="little"))
        row = rows[row]
        score = sum((((plane[row, slot // 64] >> (slot % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p for p, plane in enumerate(planes)), np.zeros(len(row), np.int64))
        new = keys.take(pa.array(first + order[row]))
        self._keep(slot, score, self.met + first + order[row], new)

    def _keep(self, slot: np.ndarray, score: np.ndarray, at: np.ndarray, keys: pa.Array) -> None:
        slot, score, at = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.at, at)))
        keys = keys if self.keys is None else pa.concat_arrays([self.keys, keys])
        order = np.lexsort((at, -score, slot))
        begun = np.flatnonzero(np.diff(slot[order], prepend=-1))
        self.rank = np.arange(len(order)) - np.repeat(begun, np.diff(np.append(begun, len(order)))) + 1
        keep = order[self.rank <= self.k]
        self.slot, self.score, self.at, self.keys, self.rank = slot[keep], score[keep], at[keep], keys.take(pa.array(keep)), self.rank[self.rank <= self.k]
        last = self.rank == self.k
        self.least[self.slot[last]] = self.score[last]


def best_chunks(mentions: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, terms: DataFrame, query: str, key: str, depth: int, k: int) -> DataFrame:
    """(query, key, score, rank): the first ``k`` of ``expanded_chunks`` for every query that is not null, by score, ties by key.

    A block of queries is one task: to it come their starts, the links once a step, and all chunks' mentions in order of their keys, as numbers. What its queries reach is a bit for each
    node and query, a chunk's count is added for 64 queries at once, and only counts above a query's ``k`` best so far are looked at. So no pair of a query and a node or chunk is a row, and what
    moves is the links and mentions for each block; blocks are as large as ``STATE_BYTES`` lets them be, and at least ``BLOCKS`` as far as there are queries.
    """
    kind = seeds.schema[key].dataType.simpleString()
    named, n = numbered(nodes.select(F.col("normalized").alias("node")).distinct())
    placed = stored(mentions.join(named, mentions["normalized"] == named["node"]).select(F.col(key), "number"))
    likes = named_like(nodes, terms, query).join(named, "node").select(query, "number")
    starts = stored(seeds.join(placed, key).select(query, "number").unionByName(likes).dropna(subset=[query]).distinct())
    asked, queries = numbered(starts.select(query).distinct())
    asked = asked.withColumnRenamed("number", "__asked")
    words = max(1, min(-(-queries // (64 * BLOCKS)), STATE_BYTES // (8 * max(1, n))))
    size = 64 * words
    blocks = max(1, -(-queries // size))
    at = [F.floor(F.col("__asked") / size).cast("int").alias("block"), (F.col("__asked") % size).cast("int").alias("slot")]
    none = lambda t: F.lit(None).cast(t)

    def row(kind_: int, a: Column, b: Column, keys: Column, first: Column) -> list[Column]:
        return [F.lit(kind_).alias("kind"), a.alias("a"), b.alias("b"), keys.alias("keys"), first.alias("first")]

    ints, lists = none("array<int>"), none(f"array<{kind}>")
    own = seeds.dropna(subset=[key]).join(asked, query).select(*at, F.col(key).alias("key")).groupBy("block").agg(F.collect_list(F.struct("slot", "key")).alias("x"))
    begun = starts.join(asked, query).select(*at, "number").groupBy("block").agg(F.collect_list(F.struct("slot", "number")).alias("x"))
    links = neighbours(edges)
    for side in ("node", "other"):
        links = links.join(named.select(F.col("node").alias(side), F.col("number").alias(f"{side}_number")), side)
    links = stored(links.select("node_number", "other_number"))
    dealt = F.pmod(F.xxhash64("other_number"), F.lit(max(1, links.count() // ROW)))
    links = links.groupBy(dealt.alias("share")).agg(F.collect_list(F.struct("node_number", "other_number")).alias("x"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    steps = links.select(F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("step"), "x").select((F.col("step") + 1).alias("kind"), F.col("x.node_number").alias("a"), F.col("x.other_number").alias("b"), lists.alias("keys"), none(kind).alias("first")) if depth else None
    chunks = stored(placed.groupBy(F.col(key).alias("key")).agg(F.collect_list("number").alias("numbers")))
    chunks = _in_rows(chunks.repartitionByRange(max(1, min(200, chunks.count() // ROW)), "key").sortWithinPartitions("key"))
    rows = own.select("block", *row(0, F.col("x.slot"), ints, F.col("x.key"), none(kind))).unionByName(begun.select("block", *row(1, F.col("x.slot"), F.col("x.number"), lists, none(kind))))
    if steps is not None:
        rows = rows.unionByName(steps.select(each, "*"))
    rows = rows.unionByName(stored(chunks).select(each, *row(depth + 2, F.col("sizes"), F.col("numbers"), F.col("keys"), F.col("first"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reach = None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if reach is not None and len(reach.slot):
                yield pa.RecordBatch.from_arrays([pa.array((now * size + reach.slot).astype(np.int32)), reach.keys, pa.array(reach.score), pa.array(reach.rank.astype(np.int32))], names=["__asked", "key", "score", "rank"])

        for batch in batches:
            for i, (block, what) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if block != now:
                    yield from ended()
                    now, reach = block, _Reach(n, words, k)
                a, b = (None if x is None else x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (batch.column(c)[i].values for c in ("a", "b")))
                if what == 0:
                    for slot, one in zip(a.tolist(), batch.column("keys")[i].as_py(), strict=True):
                        reach.own[one].append(slot)
                elif what == 1:
                    reach.start(a, b)
                elif what < depth + 2:
                    reach.go(what - 1, a, b)
                else:
                    reach.chunks(batch.column("keys")[i].values, a, b)
        yield from ended()

    tasks = min(1024, 2 * blocks)
    found = map_batches(rows.repartition(tasks, "block").sortWithinPartitions("block", "kind", "first"), run, f"__asked int, key {kind}, score long, rank int")
    return found.join(asked, "__asked").select(query, F.col("key").alias(key), "score", "rank")
