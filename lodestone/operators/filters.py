"""Row predicates of indexing and search, as column expressions that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk types that are never indexed, and quality marks that exclude a chunk.
NOT_INDEXED = ("administrative_footer", "header_footer", "empty", "parse_error", "footer")
FAILED = ("fail", "failed", "rejected")


def indexable(text: str = "text", kind: str = "chunk_type", quality: str = "quality_status", flags: Sequence[str] = ("indexable", "embedding_enabled")) -> Column:
    """Rows to be indexed: both flags set, quality not failed, type not excluded, text not blank. Null flags count as set, null marks as none."""
    on = reduce(and_, (F.coalesce(F.col(f), F.lit(True)) for f in flags))
    word = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return on & ~word(quality).isin(*FAILED) & ~word(kind).isin(*NOT_INDEXED) & F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))


def null_or_true(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(True))


def null_or_other(column: str, values: Sequence[str]) -> Column:
    """A type that is null or not in the list."""
    return ~F.coalesce(F.col(column), F.lit("")).isin(*values)


def condition(field: Column, values: Sequence | None = None, least: object = None, most: object = None, listed: bool = False) -> Column:
    """One payload condition: a value (of a list field, where ``listed``) among ``values``, or within a range. Null fields fail it."""
    if values is not None:
        wanted = F.array(*map(F.lit, values))
        hit = F.arrays_overlap(field, wanted) if listed else field.isin(*values)
    else:
        hit = reduce(and_, [F.lit(True), *([field >= F.lit(least)] if least is not None else []), *([field <= F.lit(most)] if most is not None else [])])
    return F.coalesce(hit, F.lit(False))


def payload(must: Sequence[Column] = (), must_not: Sequence[Column] = (), should: Sequence[Column] = ()) -> Column:
    """All of ``must``, none of ``must_not``, and one of ``should`` where there is any."""
    parts = [F.lit(True), *must, *(~c for c in must_not)]
    return reduce(and_, parts) & (reduce(or_, should) if should else F.lit(True))


def any_term(text: Column, terms: Sequence[str], by_tokens: bool = False) -> Column:
    """Whether a text has a term in either case; with ``by_tokens``, a term of several words also by all its words of two or more letters."""
    low, out = F.lower(text), F.lit(False)
    for term in (" ".join(t.split()) for t in terms):
        if not term:
            continue
        out = out | F.contains(low, F.lit(term.lower()))
        words = [w for w in term.replace(".", " ").split() if len(w) >= 2]
        if by_tokens and len(words) >= 2:
            out = out | reduce(and_, (F.contains(low, F.lit(w.lower())) for w in words))
    return out


def flat_metadata(outer: Column, inner: Column, drop: Sequence[str] = ("text", "content")) -> Column:
    """A payload's metadata as one map: text fields go, and outer keys win over nested ones."""
    kept = F.map_filter(outer, lambda k, v: ~k.isin(*drop))
    return F.map_concat(F.map_filter(inner, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def merged_metadata(old: Column, new: Column) -> Column:
    """Metadata after an enrichment: keys of ``new`` replace those of ``old``; a null side changes nothing."""
    empty = F.create_map().cast("map<string,string>")
    right = F.coalesce(new, empty)
    return F.map_concat(F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.map_contains_key(right, k)), right)


def enrich(chunks: DataFrame, results: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with the metadata of ``results`` (key, metadata, enriched_content, status) merged in; text changes on success only."""
    new = results.select(key, F.col("metadata").alias("_m"), F.col("enriched_content").alias("_e"), (F.col("status") == "success").alias("_ok"))
    joined = chunks.join(new, key, "left")
    content = F.when(F.coalesce("_ok", F.lit(False)), F.col("_e")).otherwise(F.col("enriched_content"))
    return joined.withColumn("metadata", merged_metadata(F.col("metadata"), F.col("_m"))).withColumn("enriched_content", content).drop("_m", "_e", "_ok")
