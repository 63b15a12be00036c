"""What rules find in a chunk, without a model: codes, dates, deadlines, quality, and the texts and keys made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Patterns and words of official documents.
OFFICIAL = ("số", "văn bản", "công văn", "quyết định")
DEADLINES = (r"tháng\s+0?\d{1,2}/\d{4}", r"trước\s+ngày\s+\d{1,2}/\d{1,2}/\d{4}", r"quý\s+0?\d{1,2}/\d{4}")
GLUED = "GIS|CSDL|CMIS|TTHT"
LETTER_OR_MORE = r"[\p{L}0-9][\p{L}0-9_/-]{2,}"
# Labels of the lines of an enriched text, with the fields they show.
LABELS = {
    "summary": "Tóm tắt", "keywords": "Từ khóa", "entities": "Thực thể", "aliases": "Tên gọi khác", "answerable_facts": "Fact trả lời trực tiếp",
    "possible_queries": "Câu hỏi có thể trả lời", "table_context": "Ngữ cảnh bảng", "legal_context": "Ngữ cảnh pháp lý",
    "document_code": "Số hiệu văn bản", "issued_date": "Ngày ban hành", "structure_path": "Đường dẫn cấu trúc",
}
# Kinds of chunks that a model must see, and kinds and states that it never sees.
MODEL_KINDS = ("table_row", "table_rows", "table_context", "assignment_section", "person_technology_assignment", "staff_matrix_row", "catalog_row_chunk")
PLAIN_KINDS = ("administrative_footer", "header_footer", "footer", "signature", "recipients", "empty", "parse_error")
FAILED = ("fail", "failed", "rejected")


def token_count(text: Column) -> Column:
    """Words and runs of punctuation; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+"), F.lit(0))), F.lit(0))


def unique(values: Column) -> Column:
    """Values in order, each once in either case; compared pairwise only where cases differ."""
    once = F.array_distinct(values)
    low = F.transform(once, lambda v: F.lower(v))
    return F.when(F.size(F.array_distinct(low)) == F.size(once), once).otherwise(F.filter(once, lambda v, i: F.array_position(low, F.lower(v)) == i + 1))


def document_codes(text: Column) -> Column:
    """Codes of a number, a slash and a name with a letter, blanks around the slash off."""
    pattern = F.lit(rf"(?<![\p{{L}}\p{{N}}_])(\d{{2,6}})\s*/\s*({LETTER_OR_MORE})")
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda n, s: F.struct(n.alias("n"), F.regexp_replace(s, r"[/-]+$", "").alias("s")))
    return unique(F.transform(F.filter(pairs, lambda p: p["s"].rlike(r"\p{L}") & (F.length(p["s"]) >= 3)), lambda p: F.concat(p["n"], F.lit("/"), p["s"])))


def dates(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])\d{1,2}/\d{1,2}/\d{4}(?![\p{L}\p{N}_])"), F.lit(0)))


def contextual_numbers(text: Column, words: Sequence[str] = OFFICIAL, before: int = 40, after: int = 80) -> Column:
    """Numbers of three to eight digits with one of ``words`` wholly within ``before`` characters before or ``after`` behind them; years of dates are none."""
    near = "|".join([rf"(?<=\Q{w}\E.{{0,{before - len(w)}}})(?=\d)" for w in words] + [rf"(?=\d+.{{0,{after - len(w)}}}\Q{w}\E)" for w in words])
    pattern = rf"(?is)(?<![\p{{L}}\p{{N}}_])(?:{near})(?!(?<=(?<!\d)\d{{1,2}}/\d{{1,2}}/)\d{{4}}(?!\d))\d{{3,8}}(?![\p{{L}}\p{{N}}_])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def deadlines(text: Column, patterns: Sequence[str] = DEADLINES) -> Column:
    """Matches of each pattern in turn, white space collapsed, each once in either case and with or without marks."""
    found = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?iu){p}"), F.lit(0)) for p in patterns)), lambda d: F.regexp_replace(d, r"\s+", " "))
    plain = F.transform(found, lambda d: T.fold(d, keep_stroke=False))
    return F.filter(found, lambda d, i: F.array_position(plain, T.fold(d, keep_stroke=False)) == i + 1)


def text_quality(text: Column) -> Column:
    """Tokens, less 3 for a single letter, 2.5 for a torn mark, 8 for a placeholder and 3 for a glued abbreviation; -100 for no text, -50 for no token."""
    count = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-zÀ-ỹ0-9_/+.:-]+"), F.lit(0))
    single = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
    torn = count(r"(?<![\p{L}\p{N}_])[A-Za-zÀ-ỹ]{1,3}\s+[À-ỹ](?![\p{L}\p{N}_])")
    glued = count(rf"(?i)(?:{GLUED})[a-zà-ỹ]|[a-zà-ỹ](?:{GLUED})")
    score = F.size(words) - 3.0 * single - 2.5 * torn - 8.0 * count("<!--|\x00") - 3.0 * glued
    return F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == "", -100.0).when(F.size(words) == 0, -50.0).otherwise(score)


def by_rules(text: Column, title: Column, first_row: Column, last_row: Column) -> Column:
    """STRUCT of what rules alone find: the first and all codes and dates, identifiers, a range of rows."""
    codes, days = document_codes(text), dates(text)
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])\d{3,8}(?![\p{L}\p{N}_])"), F.lit(0))
    begin, end = (F.coalesce(c.cast("string"), F.lit("?")) for c in (first_row, F.coalesce(last_row, first_row)))
    span = F.when(first_row.isNotNull() | last_row.isNotNull(), F.concat(begin, F.lit("-"), end))
    return F.struct(title.alias("document_title"), F.get(codes, F.lit(0)).alias("document_code"), codes.alias("doc_codes"), F.get(days, F.lit(0)).alias("issued_date"), days.alias("dates"), unique(F.concat(codes, days, numbers)).alias("identifiers"), span.alias("row_range"))


def labelled(fields: dict[str, Column], head: str = "LLM enrichment:", labels: dict[str, str] | None = None) -> Column:
    """A text of one line for each field that has a value, under its label; null where none has. Lists come joined by the caller."""
    names = LABELS if labels is None else labels
    shown = {name: F.trim(fields[name]) for name in names if name in fields}
    lines = F.array_compact(F.array(*(F.when(value != "", F.concat(F.lit(f"{names[name]}: "), value)) for name, value in shown.items())))
    return F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")))


def needs_model(text: Column, kind: Column, rules: Column, usable: Column, quality: Column, forced: Column, legal: Column, n_entities: Column, score: Column, path: Column, mode: str = "selective", least: int = 300) -> Column:
    """STRUCT<needed, reason>: whether a model is to enrich a chunk; the first of the ordered rules that holds decides. Null flags hold not, null ``usable`` does."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    low, yes = F.lower(F.coalesce(kind, F.lit("text"))), lambda c: F.coalesce(c, F.lit(False))
    marks = F.size(F.coalesce(rules["identifiers"], F.array().cast("array<string>")))
    order = [
        (False, "mode_" + mode, F.lit(mode in ("off", "metadata_only"))),
        (False, "empty_content", size == 0),
        (False, "footer_or_non_indexable", low.isin(*PLAIN_KINDS)),
        (False, "non_indexable", ~F.coalesce(usable, F.lit(True))),
        (False, "failed_quality", F.lower(F.coalesce(quality, F.lit(""))).isin(*FAILED)),
        (True, "profile_required", yes(forced)),
        (True, "mode_all", F.lit(mode == "all")),
        (True, "structured_chunk_type", low.isin(*MODEL_KINDS)),
        (True, "short_with_codes", (size < least) & (marks > 0)),
        (True, "many_identifiers", marks >= 3),
        (True, "legal_structure", yes(legal)),
        (True, "important_entities", yes(n_entities >= 2)),
        (True, "low_self_contained_score", yes(score < 0.55)),
        (False, "clear_prose_with_section_path", (size >= least) & yes(F.trim(path) != "")),
    ]
    out = None
    for needed, reason, holds in order:
        value = F.struct(F.lit(needed).alias("needed"), F.lit(reason).alias("reason"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out.otherwise(F.struct(F.lit(False).alias("needed"), F.lit("selective_no_trigger").alias("reason")))


def cache_key(text: Column, context: Column, version: str, model: str, prompt: str) -> Column:
    """SHA-256 of what an enrichment depends on, as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("content"), context.alias("context"), F.lit(model).alias("model"), F.lit(prompt).alias("prompt_version"), F.lit(version).alias("version"))), 256)


def embedding_text(text: Column, labels: dict[str, Column], enriched: Column) -> Column:
    """Labelled context lines that the text does not hold already, the text, and its enrichment, blank lines between them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    lines = [F.when((F.trim(v) != "") & ~F.contains(low, F.lower(F.trim(v))), F.concat(F.lit(f"{name}: "), F.trim(v))) for name, v in labels.items()]
    context = F.array_join(F.array_distinct(F.array_compact(F.array(*lines))), "\n")
    return F.array_join(F.filter(F.array_compact(F.array(context, F.trim(text), F.trim(enriched))), lambda p: p != ""), "\n\n")


def with_roles(kind: Column, text: Column, roles: Column, priority: Column, rules: Sequence[dict]) -> Column:
    """STRUCT<roles, priority> after rules of {role, kinds, terms, priority}: one that matches by kind (if it names kinds) and by a
    term (if it names terms) adds its role once; the least priority counts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for rule in rules:
        hit = F.coalesce(kind.isin(*rule["kinds"]), F.lit(False)) if rule.get("kinds") else F.lit(True)
        if rule.get("terms"):
            has = F.lit(False)
            for t in rule["terms"]:
                has = has | F.contains(low, F.lit(t.lower()))
            hit = hit & has
        roles = F.when(hit, F.array_union(roles, F.array(F.lit(rule["role"])))).otherwise(roles)
        if rule.get("priority") is not None:
            priority = F.when(hit, F.least(priority, F.lit(rule["priority"]))).otherwise(priority)
    return F.struct(roles.alias("roles"), priority.alias("priority"))
