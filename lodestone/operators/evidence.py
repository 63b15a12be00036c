"""Choice and order of the evidence that an answer is built from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import any_term

#: Chunk types that entity coverage searches, in order of priority.
COVERAGE_TYPES = ("docling_hybrid_repaired", "text", "docling_text", "docling_section", "table_block", "table_complete", "table_rows", "relationship_definition", "table_row", "legal_table_row", "structured_fact_row", "entity_profile", "entity_summary")
#: Chunk types by their schema priority.
SCHEMA_PRIORITY = {
    1: ("relationship_definition",),
    2: ("attribute_table_schema", "gis_relationship_schema"),
    3: ("schema_object_summary", "document_summary", "heading_outline", "section_summary"),
    7: ("table_parent", "table_complete", "table_rows"),
    9: ("schema_field_row", "table_row", "legal_table_row", "structured_fact_row"),
}


def coverage_rank(kind: Column) -> Column:
    out = F.lit(12)
    for rank, name in enumerate(COVERAGE_TYPES):
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def entity_coverage(chunks: DataFrame, terms: Sequence[str], most: int = 50, document: str = "document_id", order: str = "chunk_index", text: str = "text", kind: str = "chunk_type") -> DataFrame:
    """At most ``most`` chunks of each document that have a term (or all words of one), best type first, with their rank."""
    found = chunks.filter(F.col(kind).isin(*COVERAGE_TYPES) & any_term(F.col(text), terms, by_tokens=True))
    best = Window.partitionBy(document).orderBy(coverage_rank(F.col(kind)), order)
    return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= most)


def schema_rank(kind: Column, configured: Column | None = None, overview: Column | None = None, relation: Column | None = None) -> Column:
    """A configured priority, else 0 for an overview, 1 for a relation, and the type's."""
    out = F.lit(8)
    for rank, names in SCHEMA_PRIORITY.items():
        out = F.when(kind.isin(*names), F.lit(rank)).otherwise(out)
    if relation is not None:
        out = F.when(F.coalesce(relation, F.lit("")) != "", F.lit(1)).otherwise(out)
    if overview is not None:
        out = F.when(F.coalesce(overview, F.lit(False)), F.lit(0)).otherwise(out)
    return out if configured is None else F.coalesce(configured, out)


def table_neighbours(chunks: DataFrame, terms: Sequence[str], group: str, order: str, text: str = "text", kind: str = "chunk_type") -> DataFrame:
    """Of each group's neighbours, titles and headers first and then chunks with a term, with their rank; a group with neither keeps all."""
    support = F.col(kind).isin("table_title", "table_header")
    place = F.when(support, 0).when(any_term(F.col(text), terms), 1)
    kept = chunks.withColumn("_place", place).withColumn("_any", F.max("_place").over(Window.partitionBy(group)))
    kept = kept.filter(F.col("_place").isNotNull() | F.col("_any").isNull())
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.coalesce("_place", F.lit(0)), order)).cast("long")).drop("_place", "_any")


def whole_table(chunks: DataFrame, group: str, order: str, kind: str = "chunk_type") -> DataFrame:
    """Each table in reading order: title, header, rows (blocks where there are none), others; summaries go."""
    has_rows = F.max((F.col(kind) == "table_row").cast("int")).over(Window.partitionBy(group)) == 1
    place = F.when(F.col(kind) == "table_title", 0).when(F.col(kind) == "table_header", 1).when(F.col(kind) == "table_row", 2).when(F.col(kind) == "table_block", F.when(~has_rows, 2)).when(F.col(kind) == "entity_summary", F.lit(None)).otherwise(3)
    placed = chunks.withColumn("_place", place).filter("_place is not null")
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_place", order)).cast("long")).drop("_place")


def with_identifier(context: DataFrame, code: str, group: str, text: str = "text") -> DataFrame:
    """Of each group's context, the rows that have the code that is looked up; all rows where none has it."""
    hit = F.contains(F.lower(F.col(text)), F.lit(" ".join(code.split()).strip(" ?!.,;:").lower()))
    marked = context.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(Window.partitionBy(group)))
    return marked.filter(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


def row_evidence(context: DataFrame, terms: Sequence[str] | None, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): table-row lines that have a term; all of them where ``terms`` is None."""
    lines = context.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = lines.filter(F.contains(F.lower("line"), F.lit("table_row")) | F.contains("line", F.lit("|")))
    return rows if terms is None else rows.filter(any_term(F.col("line"), terms))


def prompt(question: Column, context: Column, sections: Sequence[tuple[str, Column]] = ()) -> Column:
    """Sections joined by blank lines, empty ones left out: the question, each titled section, then the numbered context."""
    numbered = F.array_join(F.transform(context, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    titled = [F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), body)) for title, body in sections]
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), *titled, F.concat(F.lit("Context:\n"), numbered))


def citations(context: DataFrame, text: str = "text", page: str = "page", size: int = 500) -> DataFrame:
    """Context rows as citations: the quotation cut to ``size`` characters, and the page as a number or null."""
    return context.withColumn("quote", F.substring(text, 1, size)).withColumn("page", F.expr(f"try_cast(`{page}` AS int)"))


def names_entity(context: DataFrame, entities: Sequence[str], group: str, text: str = "text") -> DataFrame:
    """(group, sufficient): whether a group's context names an entity that the question names; always where it names none."""
    hit = any_term(F.col(text), entities) if entities else F.lit(True)
    return context.groupBy(group).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("sufficient"))
