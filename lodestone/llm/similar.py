"""Near copies by exact similarity: the Jaccard similarity of two texts' sets of word shingles.

MinHash bands only find candidates. Rows that share a band are linked with its first, links make coarse clusters, and every
distinct set of a coarse cluster meets all its others in full: links are those whose exact similarity reaches the
bound, and a spanning forest of them is kept. A 64-bit fingerprint is no candidate search at this bound: texts of
similarity 0.8 differ in about 10 of its bits, and a radius for most of them makes nearly all texts candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, blocks, gram_hashes, mix, ranges, row_of, ship, stored, text_bytes, within_rows
from .simhash import components, fingerprints_of, join_heavy, name_components, only_heads, row_ids
from .simhash import links as simhash_links

SHINGLE, LEAST = 5, 0.8
#: Two sets of similarity 0.8 share one of so many bands of so many minima in all but 1 of 1500 cases; of 0.5, in 1 of 7.
BANDS, BAND_ROWS = 40, 8
#: Bytes of text of a coarse cluster that a task compares at once; a larger one is dealt out as pairs of its chunks.
CLUSTER_BYTES = 2 << 20

_FACTORS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's distinct shingle hashes, ascending, at ``first[i]:first[i + 1]``.

    Words are those of operator 8. A row with fewer words than a shingle has its whole text as one; one without words has none.
    """
    words = Words(LOWER[data], offsets)
    rows = len(offsets) - 1
    each, counts = words.hashes(), words.counts()
    full = within_rows(words.first, shingle)
    hashes, row = [gram_hashes(each, shingle)[full]], [row_of(words.first)[full]]
    for n in range(1, shingle):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(mix(gram_hashes(each, n)[words.first[short]] + np.uint64(n)))
            row.append(short)
    hashes, row = np.concatenate(hashes), np.concatenate(row)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(rows + 1))


def sketch(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set digest, bands) of each row; rows without shingles have the digest 0 and no common band."""
    rows = len(first) - 1
    digest, bands = np.zeros(rows, np.uint64), np.zeros((rows, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[full]
        digest[full] = mix(np.add.reduceat(mix(hashes), at) + np.diff(first)[full].astype(np.uint64))
        for band in range(BANDS):
            value = np.full(len(full), band + 1, np.uint64)
            for factor in _FACTORS[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                value = mix(value + np.minimum.reduceat(hashes * factor, at))
            bands[full, band] = value
    return digest, bands


def exact_links(names: np.ndarray, hashes: np.ndarray, first: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of similarity ``least`` or more connect: each set is compared with those not yet reached."""
    sizes = np.diff(first)
    order = np.argsort(hashes, kind="stable")
    owner = row_of(first)[order]
    code = np.empty(len(hashes), np.int64)
    starts = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order][:1] + np.uint64(1)))
    code[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
    ends = np.append(starts[1:], len(hashes))
    left, right, rest = [], [], np.arange(len(names))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            mine = code[first[x] : first[x + 1]]
            length = ends[mine] - starts[mine]
            index = np.repeat(starts[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
            common = np.bincount(owner[index], minlength=len(names))[rest]
            near = common >= least * (sizes[x] + sizes[rest] - common)
            left.append(np.full(int(near.sum()), names[x]))
            right.append(names[rest[near]])
            front.extend(rest[near].tolist())
            rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _sketches(rows: DataFrame, shingle: int, simhash: bool = False) -> DataFrame:
    """key, fp (the digest of its shingle set), bands and, where asked for, operator 8's fingerprint of every row of ``row_ids``."""
    ship(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, 1):
                texts = text_bytes(batch.column(1).slice(a, b - a))
                digest, bands = sketch(*shingle_sets(*texts, shingle))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
                columns = [batch.column(0).slice(a, b - a), pa.array(digest.view(np.int64)), lists]
                if simhash:
                    columns.append(pa.array(fingerprints_of(*texts).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "bands", "simhash"][: len(columns)])

    return rows.select("key", "text").mapInArrow(run, f"key {kind}, fp long, bands array<long>" + ", simhash long" * simhash)


def _simhash_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of sets: the least set of each SimHash component with all others of it."""
    pairs = stored(rows.select("simhash", "fp").distinct())
    roots = components(simhash_links(pairs.select(F.col("simhash").alias("fp")).distinct()))
    placed = pairs.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").select("fp", F.coalesce("root", "simhash").alias("root"))
    placed = stored(placed)
    least = stored(placed.groupBy("root").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    return join_heavy(placed, least, "root", placed.count()).select("a", F.col("fp").alias("b"))


def _compare(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of parts that arrive in order; a part may go over several batches."""
        held: list[pa.RecordBatch] = []

        def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Links of whole parts, about ``BLOCK_BYTES`` of their texts at a time (or one larger part)."""
            part = table["part"].to_numpy()
            at = np.append(np.flatnonzero(np.diff(part, prepend=part[0] - 1)), len(part))
            lengths = pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy().astype(np.int64)
            for i, j in ranges(np.append(0, np.cumsum(lengths))[at]):
                some = table.slice(at[i], at[j] - at[i]).combine_chunks()
                fps, cuts = some["fp"].to_numpy(), at[i : j + 1] - at[i]
                hashes, first = shingle_sets(*text_bytes(some["text"].chunk(0)), shingle)
                found = [exact_links(fps[a:b], hashes[first[a] : first[b]], first[a : b + 1] - first[a], least) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() == part[-1]:
                held.append(batch)
                continue
            whole = int(np.flatnonzero(part == part[-1])[0])
            ready = [*held, batch.slice(0, whole)] if whole else held
            if ready:
                yield from linked(pa.Table.from_batches(ready))
            held = [batch.slice(whole)]
        if held:
            yield from linked(pa.Table.from_batches(held))

    return run


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, least: float = LEAST, simhash: bool = False) -> DataFrame:
    """One row of each group that pairs of similarity ``least`` or more connect, all columns: that with the smallest key, then text hash.

    Null keys come last in their group; equal sets (texts without words too) are one group. Of rows equal in key and
    text, one stays. The hashed sets are compared whole; only the candidate search can miss a pair (see ``BANDS``).
    ``simhash`` connects what operator 8 links as well, so groups are those of both kinds of links.
    """
    named = row_ids(docs, text, key)
    rows = stored(_sketches(named, shingle, simhash))
    distinct = stored(rows.groupBy("fp").agg(F.min("key").alias("node")))
    bands = rows.filter("fp <> 0").select(F.explode("bands").alias("band"), "fp")
    least_of = stored(bands.groupBy("band").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    chain = join_heavy(bands, least_of, "band", BANDS * rows.count()).select("a", F.col("fp").alias("b"))
    coarse = components(chain).select(F.col("node").alias("fp"), "root")
    # Texts of coarse clusters only, one a distinct set.
    member = distinct.join(coarse, "fp").select("fp", "root", F.col("node.key").alias("key"), F.col("node.hash").alias("hash"), F.col("node").alias("name"))
    texts = named.select(F.col("key.key").alias("at"), F.col("key.hash").alias("its"), "text")
    same = F.col("at").eqNullSafe(F.col("key")) & (F.col("its") == F.col("hash"))
    found = stored(texts.join(member.hint("shuffle_hash"), same).select("fp", "root", "text").dropDuplicates(["fp"]))
    bulk = found.groupBy("root").agg(F.sum(F.octet_length("text")).alias("bytes")).filter(F.col("bytes") > CLUSTER_BYTES)
    split = found.join(F.broadcast(bulk.select("root", F.ceil(F.col("bytes") * 2 / CLUSTER_BYTES).cast("int").alias("chunks"))), "root", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = split.withColumn("mine", mine).withColumn("other", other)
    part = F.when(F.col("chunks").isNull(), F.col("root")).otherwise(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")))
    ordered = dealt.select(part.alias("part"), "fp", "text").repartition("part").sortWithinPartitions("part")
    links = ordered.mapInArrow(_compare(shingle, least), "a long, b long")
    if simhash:
        links = links.unionByName(_simhash_links(rows))
    heads = stored(name_components(distinct, components(links)).select(F.col("component_id").alias("head")).distinct())
    return only_heads(docs, rows, heads, text, key)
