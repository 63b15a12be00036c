"""Compiled facts: extraction, dedupe, search and the gates before they are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def numbers_outside_dates(text: Column) -> Column:
    """Distinct 3-8 digit numbers that are no part of a date."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", " "), F.lit(T.NUMBER), F.lit(0)))


def compile_identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One artifact for each identifier of a row: id, type, canonical text and a confidence by its kind."""
    found = docs.select(key, F.explode(numbers_outside_dates(F.col(text))).alias("identifier"))
    confidence = F.when(F.length("identifier") >= 6, 0.9).otherwise(0.6)
    return found.select(F.sha1(F.concat_ws(":", F.lit("identifier"), F.col(key).cast("string"), "identifier")).alias("artifact_id"), key, F.lit("identifier").alias("artifact_type"), F.col("identifier").alias("canonical_text"), confidence.alias("confidence"))


def search(artifacts: DataFrame, terms: Sequence[str], least: float, limit: int) -> DataFrame:
    """Artifacts of enough confidence that contain any term, best first."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("canonical_text"), F.lit(t.lower()))
    return artifacts.filter(hit & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "artifact_id").limit(limit)


def sufficient(found: DataFrame, least: float) -> bool:
    """Whether a (limited) search result is enough to answer from."""
    return not found.filter(F.col("confidence") >= least).isEmpty()


def clean_answer(text: Column) -> Column:
    """Without hidden-reasoning blocks, bare source headings and surplus blank lines."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?im)^\s*(sources|references):?\s*$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def merge_memories(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local and remote memories, one for each content in lower case; local ones win, then the smaller id."""
    both = local.withColumn("rank", F.lit(0)).unionByName(remote.withColumn("rank", F.lit(1)))
    best = both.groupBy(F.lower("content").alias("key")).agg(F.min_by(F.struct("id", "content", "rank"), F.struct("rank", "id")).alias("m"))
    return best.select("m.id", "m.content", F.when(F.col("m.rank") == 0, "local").otherwise("remote").alias("origin"))
