"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into three segments, whatever the size of the corpus. Every distinct fingerprint enters
one table per segment and probes it with the small Hamming ball around its own segment; by the pigeonhole rule two
fingerprints within the radius meet in some segment. A bucket of many is split by the same rule: its bits outside
the segment are cut into one part more than the radius, so that any two near members agree in a part. A bucket's
members are compared in full, and a spanning forest of its true links is kept rather than all pairs. Components
come from alternating star contractions over stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, blocks, join_words, mix, row_of, ship, stored, text_bytes, within_rows

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Buckets of up to so many fingerprints are compared all at once; larger ones grow clusters.
SMALL_BUCKET = 16
SEGMENTS = 3
#: Rows of a bucket from which it is split by the bits outside its segment.
SPLIT_ROWS = 1 << 12
#: Fingerprints that a task compares at once; a split bucket of more (fingerprints that are all near each other) is dealt out as pairs of its chunks.
BUCKET_ROWS = 1 << 20
#: A key of at least this share of a table is joined by broadcast: there are at most so many of them.
HEAVY = 1000


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """A fingerprint for each row."""
    words = Words(LOWER[data], offsets)
    n, rows = len(words), len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    if not n:
        return out
    joined, starts, ends = join_words(words)
    raw = joined.tobytes()
    counts = words.counts()
    full = within_rows(words.first, shingle)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    begin = np.concatenate((starts[full], starts[words.first[short]]))
    end = np.concatenate((ends[full + shingle - 1], ends[words.first[short + 1] - 1]))
    row = np.concatenate((row_of(words.first)[full], short))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))
    order = np.argsort(row, kind="stable")
    hashes, row = hashes[order], row[order]
    at = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(np.append(at, len(row)))
    # Bit counts in bounded pieces, cut between rows.
    piece = 0
    while piece < len(at):
        stop = max(piece + 1, int(np.searchsorted(at, at[piece] + (1 << 17), side="left")))
        a, b = at[piece], at[stop] if stop < len(at) else len(row)
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, at[piece:stop] - a, axis=0, dtype=np.int32)
        out[row[at[piece:stop]]] = np.packbits(ones * 2 > sizes[piece:stop, None], axis=1).view(">u8").ravel()
        piece = stop
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (the fingerprint's bits as a signed long) of every row."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(*text_bytes(batch.column(1).slice(a, b - a))) for a, b in blocks(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _edges(segments: int) -> list[tuple[int, int]]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _ball(a: int, b: int, size: int) -> list[np.uint64]:
    return [np.uint64(sum(1 << f for f in flips)) for n in range(size + 1) for flips in combinations(range(b - a), n)]


def own_values(fps: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Every fingerprint's segments, each tagged with its number in bits 40 and up."""
    return np.concatenate([(fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) | np.uint64(s << 40) for s, (a, b) in enumerate(_edges(segments))])


def reached(values: np.ndarray, radius: int = RADIUS, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place among ``values``): each tagged value's own bucket and its ball's values that set bits.

    Of two values that differ in some bits, the one with most of them unset reaches the other or
    both reach the value with all of them set, so balls need no cleared bits.
    """
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    tags = values >> np.uint64(40)
    for s, (a, b) in enumerate(_edges(segments)):
        mine = np.flatnonzero(tags == s)
        for mask in _ball(a, b, radius // segments):
            free = mine[(values[mine] & mask) == 0]
            keys.append(values[free] | mask)
            places.append(free)
    return np.concatenate(keys), np.concatenate(places)


def probes(fps: np.ndarray, hot: np.ndarray | None = None, radius: int = RADIUS, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, fingerprint, whether split) rows; rows of the buckets ``hot`` (ascending) go to ``radius + 1`` smaller buckets instead."""
    keys, places = reached(own_values(fps, segments), radius, segments)
    members = fps[places % max(1, len(fps))]
    if hot is None or not len(hot):
        return keys, members, np.zeros(len(keys), bool)
    split = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
    many_keys, many = keys[split], members[split]
    out = [(keys[~split], members[~split], np.zeros(int((~split).sum()), bool))]
    for s, (a, b) in enumerate(_edges(segments)):
        mine = (many_keys >> np.uint64(40)) == s
        outside = [x for x in range(64) if not a <= x < b]
        for part in range(radius + 1):
            bits = outside[len(outside) * part // (radius + 1) : len(outside) * (part + 1) // (radius + 1)]
            mask = np.uint64(sum(1 << x for x in bits))
            # The key's top bit sets the smaller buckets apart from the others.
            key = mix(mix(many_keys[mine] * np.uint64(radius + 1) + np.uint64(part)) ^ (many[mine] & mask)) | np.uint64(1 << 63)
            out.append((key, many[mine], np.ones(len(key), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links found in whole buckets (``keys`` ascending): all of a small bucket, a spanning forest of a large one."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
    sizes = np.diff(np.append(first, len(keys)))
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = (sizes > 1) & (sizes <= SMALL_BUCKET)
    rest = np.repeat(np.where(small, first + sizes, 0), sizes)
    for shift in range(1, SMALL_BUCKET):
        at = np.flatnonzero(np.arange(len(keys)) + shift < rest)
        if not len(at):
            break
        good = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= radius]
        left.append(fps[good])
        right.append(fps[good + shift])
    for at in np.flatnonzero(sizes > SMALL_BUCKET).tolist():
        a, b = _forest(fps[first[at] : first[at] + sizes[at]], radius)
        left.append(a)
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    other = a != b
    return a[other], b[other]


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected: each member is compared with those not yet reached."""
    left, right, rest = [], [], np.unique(fps)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                new, rest = rest[near], rest[~near]
                left.append(np.full(len(new), x))
                right.append(new)
                front.extend(new)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _probe_batches(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                keys, members, split = probes(fps[at : at + 4096], None if hot is None else hot.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(members.view(np.int64)), pa.array(split)], names=["bucket", "fp", "split"])

    return run


def _value_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, n) of the tagged segments of fingerprints."""
    for batch in batches:
        values, n = np.unique(own_values(batch.column(0).to_numpy().view(np.uint64)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["value", "n"])


def _reach_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) that the counted values (value, n) bring."""
    for batch in batches:
        keys, places = reached(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(batch.column(1).to_numpy()[places])], names=["bucket", "n"])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that arrive in order; a bucket may go over several batches."""
    keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def linked(n: int) -> pa.RecordBatch:
        a, b = bucket_links(keys[:n], fps[:n])
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0].copy().view(np.int64)), pa.array(pair[1].copy().view(np.int64))], names=["a", "b"])

    held = []
    for batch in batches:
        held.append(batch)
        new = batch.column(0).to_numpy().view(np.uint64)
        if not len(new) or (len(keys) or len(held) > 1) and new[0] == new[-1] == (held[0].column(0)[0].as_py() if not len(keys) else keys[-1]):
            continue
        keys = np.concatenate([keys, *(x.column(0).to_numpy().view(np.uint64) for x in held)])
        fps = np.concatenate([fps, *(x.column(1).to_numpy().view(np.uint64) for x in held)])
        held = []
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole:
            yield linked(whole)
            keys, fps = keys[whole:], fps[whole:]
    keys = np.concatenate([keys, *(x.column(0).to_numpy().view(np.uint64) for x in held)])
    fps = np.concatenate([fps, *(x.column(1).to_numpy().view(np.uint64) for x in held)])
    if len(keys):
        yield linked(len(keys))


def hot_buckets(distinct: DataFrame) -> np.ndarray:
    """The buckets of more than ``SPLIT_ROWS`` rows, ascending.

    They are counted over the values of segments, of which there are at most 3 * 2**22 however many fingerprints there
    are; so that many rows are the most that is exchanged, and that many buckets the most that is collected.
    """
    values = distinct.select("fp").mapInArrow(_value_batches, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    rows = values.mapInArrow(_reach_batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.filter(F.col("n") > SPLIT_ROWS).select("bucket").toArrow()["bucket"].to_numpy()
    return np.sort(found.view(np.uint64))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; ``distinct`` has one column fp."""
    hot = hot_buckets(distinct)
    shared = distinct.sparkSession.sparkContext.broadcast(hot) if len(hot) else None
    rows = distinct.select("fp").mapInArrow(_probe_batches(shared), "bucket long, fp long, split boolean")
    if len(hot):
        full = rows.filter("split").groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
        # At most rows / BUCKET_ROWS buckets are full. Each pair of such a bucket's chunks is a bucket of its own.
        dealt = rows.join(F.broadcast(full.withColumn("chunks", F.ceil(F.col("n") * 2 / BUCKET_ROWS).cast("int")).drop("n")), "bucket", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = dealt.withColumn("mine", mine).withColumn("other", other).select(F.when(F.col("chunks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).alias("bucket"), "fp")
    ordered = rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(_link_batches, "a long, b long").distinct()


def join_heavy(left: DataFrame, right: DataFrame, on: str, total: int, key: Column | None = None) -> DataFrame:
    """``left`` joined with the one row of ``right`` (on, n, ...) for its key; a key of a great share of the ``total`` rows of ``left`` is never dealt to one task.

    ``key`` is the expression of ``on`` where ``left`` has no such column.
    """
    left = left if key is None else left.withColumn(on, key)
    heavy = F.broadcast(right.filter(F.col("n") * HEAVY >= F.lit(max(total, HEAVY))).drop("n"))  # at most HEAVY rows
    light = right.filter(F.col("n") * HEAVY < F.lit(max(total, HEAVY))).drop("n")
    rest = left.join(heavy.select(on), on, "left_anti").join(light, on)
    return left.join(heavy, on).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being its component's smallest node.

    Alternates large-star and small-star contraction until nothing changes; each round is stored, so
    neither lineage nor the driver holds links. A hub's links are 16 bytes each; where they outgrow a task, adaptive execution
    splits its side of these sort-merge joins.
    """
    now, seen = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lower.select("u", F.col("m").alias("v")))
        now = stored(small.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def cluster(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, fingerprint (16 hex digits), component_id (smallest key it is linked with, itself included).

    Texts without words have the zero fingerprint, linked like any other. Null keys get a row and never name a
    component unless it has no other key. Repeated rows are each answered. Extra columns are ignored.
    """
    rows = stored(fingerprints(docs, text, key))
    distinct, by_fp = _components_of(rows)
    counts = by_fp.join(distinct.select("fp", "n"), "fp")
    named = join_heavy(rows, stored(counts), "fp", rows.count())
    return named.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (key, fp): the distinct fingerprints (fp, node: the smallest key, n: rows), and (fp, component_id) of each."""
    distinct = stored(rows.groupBy("fp").agg(F.min("key").alias("node"), F.count("*").alias("n")))
    return distinct, name_components(distinct, components(links(distinct)))


def name_components(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest ``node`` of the component that ``roots`` (node, root) puts each fp of ``distinct`` in."""
    least = distinct.select("fp", F.col("node").alias("least")).join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = stored(least.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = stored(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    return join_heavy(named.select("fp", "root"), names, "root", named.count()).select("fp", "component_id")


def row_ids(docs: DataFrame, text: str, key: str) -> DataFrame:
    """text and key, the latter a struct that names a row by key and text hash; null keys come last."""
    name = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"))
    return docs.select(name.alias("key"), F.col(text).alias("text"))


def only_heads(docs: DataFrame, rows: DataFrame, heads: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` that ``heads`` (head, of ``row_ids``) names, one a name; ``rows`` has the name of every row."""
    none, named, hashed = (f"__lodestone_{x}" for x in ("none", "key", "hash"))
    parts = [F.col("head.key").alias(named), F.col("head.hash").alias(hashed)]
    same = F.col(key).eqNullSafe(F.col(named)) & (F.xxhash64(F.col(text)) == F.col(hashed))
    # A shuffled hash join at every size: the narrow side is hashed, and texts are dealt out once and not sorted.
    marked = docs.join(heads.select(*parts).hint("shuffle_hash"), same, "left_semi")
    counted = rows.groupBy(F.col("key").alias("head")).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = stored(counted.join(heads, "head", "left_semi").select(*parts, F.lit(True).alias(none)))
    if repeated.isEmpty():
        return marked
    tied = marked.join(repeated.hint("shuffle_hash"), same, "left")
    single = tied.filter(F.col(none).isNull()).select(*docs.columns)
    several = tied.filter(F.col(none).isNotNull()).dropDuplicates([named, hashed]).select(*docs.columns)
    return single.unionByName(several)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", null_keys: bool = False) -> DataFrame:
    """One row of each component, all columns: that with the smallest key, then the smallest text hash.

    Rows are told apart by key and text, so equal keys with unlike texts are separate rows; of rows equal in both, one
    stays. Rows with a null key stay as they are, unless ``null_keys``: then they are members like any other and come
    after all named ones of their component.
    """
    rows = stored(fingerprints(row_ids(docs, text, key), "text", "key"))
    heads = stored(_components_of(rows)[1].select(F.col("component_id").alias("head")).distinct())
    if null_keys:
        return only_heads(docs, rows, heads, text, key)
    named = only_heads(docs.filter(F.col(key).isNotNull()), rows, heads, text, key)
    return named.unionByName(docs.filter(F.col(key).isNull()))
