"""Sharding of documents by Karmarkar-Karp differencing.

Equal texts are one indivisible group. Light groups are dealt into hash buckets of about ``BUCKET`` each, and each bucket is
differenced into ``ATOMS`` bundles; while there are more than ``TOP`` bundles, these are dealt and differenced in turn. The last
bundles and the heavy groups (at least a fixed share of all bytes, so their number is bounded) are differenced on the
driver, which gets at most ``TOP + HEAVY`` sums, and a task one bucket, whatever the corpus.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

#: Items that a task differences at once, and bundles that the driver does.
BUCKET, TOP = 2000, 1 << 15
#: Runs of rows by which slots are numbered.
RUNS = 4096
#: A group of at least ``total / HEAVY`` bytes is dealt out on its own; there are at most so many.
HEAVY = 8192
ATOMS = 8


def differencing(weights: list[int], k: int) -> list[int]:
    """The part of each weight, by k-way Karmarkar-Karp differencing.

    Each weight begins as a partial partition (w, 0, ..., 0). The two partial partitions with the
    largest spread are combined, the largest part of one with the smallest of the other, until
    one is left. Ties go to the earlier weight.
    """
    n = len(weights)
    if not n:
        return []
    sums: list[list[int]] = [[w] + [0] * (k - 1) for w in weights]
    made: list[tuple[int, int, list[int]]] = []
    heap = [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        order = sorted(range(k), key=both.__getitem__, reverse=True)
        made.append((a, b, order))
        sums[a] = sums[b] = []
        sums.append([both[j] for j in order])
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    place: list[list[int] | None] = [None] * len(sums)
    place[-1] = list(range(k))
    for node in range(len(made) - 1, -1, -1):
        a, b, order = made[node]
        here = place[n + node]
        left, right = [0] * k, [0] * k
        for at, j in enumerate(order):
            left[j] = here[at]
            right[k - 1 - j] = here[at]
        place[a], place[b], place[n + node] = left, right, None
    return [p[0] for p in place[:n]]


def _atoms(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
    return pd.DataFrame({"item": pdf["item"], "bundle": pdf["bucket"] * ATOMS + differencing(pdf["weight"].tolist(), ATOMS), "weight": pdf["weight"]})


def bundled(items: DataFrame, n: int, least: int = 64) -> tuple[list[DataFrame], DataFrame]:
    """Levels of (item, bundle), and the last bundles (item, weight), at most ``TOP`` of them; ``items`` has n rows (item binary, weight)."""
    levels: list[DataFrame] = []
    while n > TOP or not levels:
        buckets = max(least, -(-n // BUCKET))
        dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
        level = stored(dealt.groupBy("bucket").applyInPandas(_atoms, "item binary, bundle long, weight long"))
        levels.append(level.select("item", "bundle"))
        # A bundle's name as eight bytes: items of all levels are alike.
        items = level.groupBy("bundle").agg(F.sum("weight").alias("weight")).select(F.unhex(F.lpad(F.hex("bundle"), 16, "0")).alias("item"), "weight")
        n, least = min(n, buckets * ATOMS), 1
    return levels, items


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes; equal texts stay together.

    Returns the key, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null: under
    this law one more shard may move any row). A row's size is its text's UTF-8 bytes plus 1.
    Null and empty texts are one group of size-1 rows. A group larger than an even share fills
    a shard that gets nothing else. Repeated rows get a slot each; null keys come first in
    their bucket's order. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(key).alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("group")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("weight")).withColumnRenamed("group", "item"))
    heavy = F.col("weight") * F.lit(HEAVY) >= F.lit(total)
    light = groups.filter(~heavy)
    levels, last = bundled(light, light.count())
    alone = groups.filter(heavy).withColumn("alone", F.lit(True))
    items = last.withColumn("alone", F.lit(False)).unionByName(alone).collect()  # bounded: see above
    items.sort(key=lambda r: (-r["weight"], r["alone"], bytes(r["item"])))
    dealt = [(r["item"], r["alone"], s) for r, s in zip(items, differencing([r["weight"] for r in items], shards), strict=True)]
    placed = spark.createDataFrame(dealt, "item binary, alone boolean, shard int")
    heavy_place = F.broadcast(placed.filter("alone").select(F.col("item").alias("heavy_group"), F.col("shard").alias("heavy_shard")))  # at most HEAVY rows
    where = F.broadcast(placed.filter("NOT alone").select("item", "shard"))  # at most TOP rows
    for level in reversed(levels):
        above = where.withColumnRenamed("item", "name")
        where = level.withColumn("name", F.unhex(F.lpad(F.hex("bundle"), 16, "0"))).join(above, "name").select("item", "shard")
    where = where.withColumnRenamed("item", "group")
    # Rows of heavy groups are placed by the broadcast table, so no hot group crosses a shuffle.
    known = rows.join(heavy_place, rows["group"] == heavy_place["heavy_group"], "left").drop("heavy_group")
    rest = known.filter("heavy_shard IS NULL").drop("heavy_shard").join(where, "group")
    placed_rows = rest.unionByName(known.filter("heavy_shard IS NOT NULL").withColumnRenamed("heavy_shard", "shard"))
    runs = min(RUNS, max(16, n // 100_000))
    placed_rows = stored(placed_rows.withColumn("run", F.pmod(F.xxhash64("key", "group", F.monotonically_increasing_id()), F.lit(runs)).cast("int")))
    counts = placed_rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("shard", "run").orderBy("key", "group"))
    return (
        placed_rows.withColumn("local", local)
        .join(F.broadcast(before.drop("n")), ["shard", "run"])  # at most shards * RUNS rows
        .select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("local") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
