"""Headings, sections, table packing, neighbours, furniture, and scoring of structured lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import map_batches
from .limits import packed


def headings(lines: DataFrame, rules: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Lines that a rule (name, pattern, level) matches, with the first such rule's name and level."""
    name = level = None
    for rule, pattern, depth in rules:
        hit = F.col("line").rlike(pattern)
        name = F.when(hit, rule) if name is None else name.when(hit, rule)
        level = F.when(hit, depth) if level is None else level.when(hit, depth)
    return lines.withColumn("rule", name).withColumn("level", level).filter(F.col("rule").isNotNull())


def spans(marks: DataFrame, key: str, start: str, total: Column) -> DataFrame:
    """Each mark's range up to the next one of its row, or to the row's end."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return marks.withColumn("until", F.coalesce(after, total))


def pack(rows: DataFrame, key: str, position: str, size: str, limit: int) -> DataFrame:
    """(key, block, first, last, total): rows in order, greedily packed into blocks of at most ``limit`` (a larger row stands alone).

    Only positions and sizes of a key's rows come together, and are gone through once. Null sizes count as 0.
    """
    kind = rows.schema[key].dataType.simpleString()
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).cast("long").alias("at"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))))
    lists = rows.groupBy(F.col(key).alias("key")).agg(ordered.alias("rows")).select("key", F.transform("rows", lambda r: r["at"]).alias("at"), F.transform("rows", lambda r: r["size"]).alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, at, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, total, block = 0, 0, 0
                parts = packed(sizes, limit)
                for i, n in enumerate(sizes):
                    total += n
                    if i + 1 == len(sizes) or parts[i + 1] != parts[i]:
                        out.append((k, block, at[first], at[i], total))
                        first, total, block = i + 1, 0, block + 1
            types = (batch.schema.field(0).type, *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)], names=["key", "block", "first", "last", "total"])

    return map_batches(lists, run, f"key {kind}, block long, first long, last long, total long").withColumnRenamed("key", key)


def with_neighbours(lines: DataFrame, key: str, hit: Column, reach: int = 1) -> DataFrame:
    """Lines that hit or lie within ``reach`` lines of one that does."""
    near = Window.partitionBy(key).orderBy("line_no").rowsBetween(-reach, reach)
    return lines.withColumn("near", F.bool_or(F.coalesce(hit, F.lit(False))).over(near)).filter("near").drop("near")


def furniture(lines: DataFrame, key: str, least: int) -> DataFrame:
    """Lines that stand in at least ``least`` rows, and in how many: counted once a row before the shuffle."""
    per_row = lines.select(key, F.trim("line").alias("line")).distinct()
    return per_row.groupBy("line").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= least)


def without_furniture(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    return lines.withColumn("_line", F.trim("line")).join(repeated.select(F.col("line").alias("_line")), "_line", "left_anti").drop("_line")


def row_score(tokens: Column, query: Sequence[str]) -> Column:
    """0.75 recall + 0.25 precision + 0.05 for each shared token."""
    wanted = F.array(*map(F.lit, query))
    both = F.size(F.array_intersect(wanted, tokens))
    return 0.75 * both / len(set(query)) + 0.25 * both / F.greatest(F.size(F.array_distinct(tokens)), F.lit(1)) + 0.05 * both


def count_evidence(lines: DataFrame, query: Sequence[str], phrases: Sequence[str]) -> DataFrame:
    """Lines with a number, scored by shared tokens and 2.5 for each phrase."""
    shared = F.size(F.array_intersect(F.array(*map(F.lit, query)), T.tokens(F.col("line"), "[a-z0-9]+")))
    for p in phrases:
        shared = shared + F.when(F.contains(F.lower("line"), F.lit(p)), 2.5).otherwise(0.0)
    return lines.filter(F.col("line").rlike(r"[0-9]")).withColumn("score", shared.cast("double"))


def profile(text: Column, rules: dict[str, Sequence[str]], least: int = 2) -> Column:
    """STRUCT<profile, score> of the rule set with most keyword hits (2 each; ties: by name), null below ``least``."""
    low = F.lower(text)
    scores = []
    for name in sorted(rules):
        total = F.lit(0)
        for word in rules[name]:
            total = total + F.when(F.contains(low, F.lit(word)), 2).otherwise(0)
        scores.append(F.struct((-total).alias("less"), F.lit(name).alias("profile")))
    best = F.get(F.array_sort(F.array(*scores)), F.lit(0))
    return F.struct(F.when(-best["less"] >= least, best["profile"]).alias("profile"), (-best["less"]).cast("long").alias("score"))
