"""Context assembly: dedupe, budgets, merging of broken lines, evidence gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def dedupe(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The row with the least key for each normalised content, and how many rows shared it.

    Contents are grouped by a digest with partial aggregation, so no copy but one crosses the shuffle as text.
    """
    digest = F.sha2(T.collapse(F.col(text)), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def within_budget(rows: DataFrame, group: str, size: str, budget: int, *order: Column) -> DataFrame:
    """Rows of each group while their running size stays within the budget."""
    running = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).filter(F.col("running") <= budget)


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line) of all non-blank lines."""
    split = F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    return rows.select(key, split).filter(F.trim("line") != "")


def merge_broken_lines(numbered: DataFrame, key: str) -> DataFrame:
    """Join a line to the one before it that lacks an end mark, if it starts in lower case."""
    w = Window.partitionBy(key).orderBy("line_no")
    joined = ~F.lag("line").over(w).rlike(r"[.!?:;]\s*$") & F.col("line").rlike(r"^\p{Ll}")
    begun = numbered.withColumn("begins", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    grouped = begun.withColumn("block", F.sum("begins").over(w))
    return grouped.groupBy(key, "block").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("merged"))


def sections(numbered: DataFrame, key: str, heading: Column) -> DataFrame:
    """Each line with the latest heading at or before it (null before the first)."""
    w = Window.partitionBy(key).orderBy("line_no")
    return numbered.withColumn("heading", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(w))


def topical(term_hits: Column, n_terms: int, phrase_hit: Column) -> Column:
    """The relevance gate: a phrase hit, or half of the terms (for more than ten: 60 per cent and six at least)."""
    needed = max(6, -(-n_terms * 6 // 10)) if n_terms > 10 else -(-n_terms // 2)
    return phrase_hit | (term_hits >= needed)
