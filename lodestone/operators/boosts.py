"""Additive boosts of hybrid retrieval, from a chunk's text and metadata columns against one query."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import question as Q
from ..functions import text as T

#: Question words that are no content, without marks.
STOP_WORDS = "anh ban cac cho co cua duoc gi hoi khong khi la lam nao nay neu nhu noi sao theo thi toi trong va ve voi xin bao nhieu may".split()
#: Metadata fields that a query may name, and what each is worth.
FIELD_WORTH = (("object_code", 8.0), ("field_name", 10.0), ("relationship_name", 9.0), ("table_name", 5.0), ("source_data", 2.0), ("data_type", 1.0))
#: Words for schemas and for counting, without marks.
SCHEMA_WORDS = ("schema", "database", "table", "column", "field", "attribute", "layer", "object", "csdl", "co so du lieu", "bang", "cot", "truong", "thuoc tinh", "lop", "doi tuong")
COUNT_WORDS = ("how many", "number of", "count", "may", "bao nhieu", "so luong")
DEADLINE_WORDS = ("deadline", "thoi han", "khi nao", "hoan thanh")
EXACT, IN_METADATA, MISSED = 50.0, 12.0, -0.02


def query_tokens(query: str) -> list[str]:
    """Distinct content tokens of a query, without marks."""
    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", Q.fold(query)) if len(t) > 1 and t not in STOP_WORDS))


def share(query: Sequence[str], text: Column) -> Column:
    """The share of a query's tokens that a text has; null where it has none of them."""
    have = F.regexp_extract_all(T.fold(text, keep_stroke=False), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.size(F.array_intersect(F.array(*map(F.lit, query)).cast("array<string>"), have))
    return F.when(n > 0, n / len(query)) if query else F.lit(None).cast("double")


def enrichment(query: str, enriched: Column) -> Column:
    """3 + 8 x the share of the query's tokens in the enrichment; 0 without any."""
    return F.coalesce(3.0 + 8.0 * share(query_tokens(query), enriched), F.lit(0.0))


def structured_row(query: str, content: Column, kind: Column, case_name: Column, unit: Column, confidence: Column, warning: Column) -> Column:
    """8 + 30 x share for rows and sections, 4 more for rows and 4 for a key field; 0 for a doubtful parse."""
    named, in_section = F.coalesce(case_name, F.lit("")) != "", F.coalesce(unit, F.lit("")) != ""
    row = F.coalesce(F.contains(kind, F.lit("row")) | F.contains(kind, F.lit("table")), F.lit(False)) | named
    worth = 8.0 + 30.0 * share(query_tokens(query), F.concat_ws(" ", content, case_name, unit)) + F.when(row, 4.0).otherwise(0.0) + F.when(case_name.isNotNull() | unit.isNotNull(), 4.0).otherwise(0.0)
    doubtful = F.coalesce(warning, F.lit(False)) & (F.coalesce(confidence, F.lit(1.0)) < 0.5)
    return F.when(doubtful | ~(row | in_section), 0.0).otherwise(F.coalesce(worth, F.lit(0.0)))


def schema(query: str, fields: dict[str, Column], kind: Column, field_detail: bool = False) -> Column:
    """Worth of the metadata values that a query names, and of schema chunks for questions that count or ask for deadlines."""
    q = " ".join(Q.fold(query).split())
    out = F.lit(0.0)
    for name, worth in FIELD_WORTH:
        if name in fields:
            value = T.fold(F.coalesce(fields[name], F.lit("")), keep_stroke=False)
            out = out + F.when((value != "") & F.contains(F.lit(q), value), worth).otherwise(0.0)
    counts = any(w in q for w in SCHEMA_WORDS) and any(w in q for w in COUNT_WORDS)
    has = lambda name: F.coalesce(fields[name], F.lit("")) != "" if name in fields else F.lit(False)
    if counts:
        tables = kind.isin("table_parent", "table_complete", "table_rows") & has("table_name")
        out = out + F.when(kind == "attribute_table_schema", 24.0).when(kind == "gis_relationship_schema", 20.0).when(kind == "schema_object_summary", 16.0).when(tables, 18.0 if field_detail else 8.0).otherwise(0.0)
        out = out + F.when(has("relationship_name") | has("target_table"), 6.0 if field_detail else 16.0).otherwise(0.0)
    late = any(w in q for w in DEADLINE_WORDS)
    own = {"schema_field_row": 4.0 if field_detail else 0.0, "schema_object_summary": 3.0, "procedure_table_row": 4.0, "deadline_index": 8.0 if late else 0.0, "assignment_section": 3.0 if late else 0.0, "gis_relationship_schema": 5.0, "attribute_table_schema": 6.0 if counts else 2.0}
    extra = F.lit(0.0)
    for name, worth in own.items():
        extra = F.when(kind == name, worth).otherwise(extra)
    return out + extra


def identifier(query: str, content: Column, codes: Column, titles: Column) -> Column:
    """50 where the text has a code that is looked up, 50 where the chunk's codes do, 12 where its titles do; -0.02 where all miss."""
    terms = [t.casefold() for t in Q.identifiers(query)]
    if not terms:
        return F.lit(0.0)
    has = lambda c: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.coalesce(c, F.lit(""))), t))
    worth = sum((F.when(has(c), w).otherwise(0.0) for c, w in ((content, EXACT), (codes, EXACT), (titles, IN_METADATA))), F.lit(0.0))
    return F.when(worth > 0, worth).otherwise(MISSED)


def membership(person: str, area: str, content: Column, kind: Column, warning: Column) -> Column:
    """2 for the person, 2 for the area, 6 more for both, 4 in a profile and 3 in a row; 0 in what cannot be trusted."""
    low = T.fold(F.coalesce(content, F.lit("")), keep_stroke=False)
    has = lambda x: F.contains(low, F.lit(Q.fold(x))) if x else F.lit(False)
    one, two = has(person), has(area)
    score = F.when(one, 2.0).otherwise(0.0) + F.when(two, 2.0).otherwise(0.0) + F.when(one & two, 6.0).otherwise(0.0) + F.when(kind == "entity_profile", 4.0).when(kind == "table_row", 3.0).otherwise(0.0)
    return F.when(F.coalesce(warning, F.lit(False)) | kind.isin("table_block", "entity_summary") | ~(one | two), 0.0).otherwise(score)
