"""Passes over the records of a document: articles, heading chains, references, conflicts, repeated lines, kinds of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Heading lines of legal texts, their keywords, the marks of administrative letters and of schema tables.
ARTICLE = r"(?iu)^\s*(?:\*\*)?Điều\s+(\d+)\s*[.:\-]?\s*(.*?)(?:\*\*)?\s*$"
CHAPTER = r"(?iu)^\s*(?:\*\*)?CHƯƠNG\s+([IVXLCDM]+|\d+)\s*[.:\-]?\s*(.*?)(?:\*\*)?\s*$"
LEGAL_WORDS = ("thỏa ước lao động tập thể", "quy chế", "quy định", "nghị định", "thông tư", "quyết định", "bộ luật lao động")
LETTER_MARKS = ("kính gửi", "nơi nhận", "cộng hòa xã hội chủ nghĩa việt nam", "kt. tổng giám đốc", "tổng công ty")
SCHEMA_MARKS = ("trường dữ liệu", "kiểu dữ liệu", "nguồn dữ liệu")
REFERENCE = r"(?iu)(?:theo|tại)\s+mục\s+(\d+(?:\.\d+)*)"
CODE_WITH_PREFIX = r"(?<![\p{L}\p{N}_])F(\d{2})_([A-Za-z0-9_]+)"


def _starts(lines: Column, pattern: str) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())


def articles(docs: DataFrame, article: str = ARTICLE, chapter: str = CHAPTER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, article_no, number, title, chapter, first_line, until_line, content): from each article's heading to the next one or the
    next chapter, whichever comes first. ``chapter`` is the number of the last chapter before it, if any. All inside the row."""
    lines = docs.select(key, F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    found = lines.withColumn("heads", _starts(F.col("lines"), article)).withColumn("chapters", _starts(F.col("lines"), chapter)).filter(F.size("heads") > 0)

    def one(at: Column, i: Column) -> Column:
        ends = F.concat(F.filter("chapters", lambda c: c > at), F.array(F.coalesce(F.get("heads", i + 1), F.size("lines"))))
        head, until, own = F.get("lines", at), F.array_min(ends), F.try_element_at(F.filter("chapters", lambda c: c < at), F.lit(-1))
        return F.struct(
            (i + 1).cast("long").alias("article_no"), F.regexp_extract(head, article, 1).alias("number"), F.regexp_extract(head, article, 2).alias("title"),
            F.regexp_extract(F.get("lines", own), chapter, 1).alias("chapter"), at.cast("long").alias("first_line"), until.cast("long").alias("until_line"),
            F.array_join(F.slice("lines", at + 1, until - at), "\n").alias("content"))

    return found.select(key, F.explode(F.transform("heads", one)).alias("a")).select(key, "a.*")


def is_legal(text: Column, article: str = ARTICLE, chapter: str = CHAPTER, words: Sequence[str] = LEGAL_WORDS, least: int = 4) -> Column:
    """At least ``least`` articles, and a chapter or one of the words."""
    lines, low = F.split(F.coalesce(text, F.lit("")), "\n"), F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    named = F.exists(lines, lambda x: x.rlike(chapter))
    for w in words:
        named = named | F.contains(low, F.lit(w))
    return (F.size(F.filter(lines, lambda x: x.rlike(article))) >= least) & named


def collapse_leads(records: DataFrame, key: str, order: str, lead: Column, page: str, text: str) -> DataFrame:
    """Chains of adjacent records that are only headings, on the same or the next page, become one: the last one's place, all texts."""
    w = Window.partitionBy(key).orderBy(order)
    marked = records.withColumn("_lead", F.coalesce(lead, F.lit(False)))
    joins = F.coalesce(F.col("_lead") & F.lag("_lead").over(w) & (F.abs(F.col(page) - F.lag(page).over(w)) <= 1), F.lit(False))
    chained = marked.withColumn("_joins", joins).withColumn("_chain", F.sum((~F.col("_joins")).cast("long")).over(w))
    return chained.groupBy(key, "_chain").agg(
        F.max(order).alias(order), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n_joined"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t")))), lambda s: s["t"]), "\n").alias(text)).drop("_chain")


def cross_references(records: DataFrame, key: str, order: str, section: str, text: str, pattern: str = REFERENCE) -> DataFrame:
    """(key, order, reference, resolved): every section that a record's text refers to, once, with the text of the first record of that
    section in the same document, null where there is none (a warning)."""
    found = records.select(key, order, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("reference"))
    heads = records.filter(F.col(section) != "").groupBy(key, F.col(section).alias("reference")).agg(F.min_by(text, order).alias("resolved"))
    return found.join(heads, [key, "reference"], "left")


def conflicts(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = CODE_WITH_PREFIX) -> DataFrame:
    """(key, suffix, prefixes): suffixes of identifiers, in lower case, that a row has under more than one prefix (groups 2 and 1)."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda p, s: F.struct(F.lower(s).alias("suffix"), p.alias("prefix")))
    found = docs.select(key, F.explode(F.array_distinct(pairs)).alias("x")).groupBy(key, "x.suffix").agg(F.array_sort(F.collect_set("x.prefix")).alias("prefixes"))
    return found.filter(F.size("prefixes") > 1)


def without_recent(text: Column, reach: int = 12) -> Column:
    """A text without lines that equal, white space and case aside, one of the last ``reach`` lines kept; runs of blank lines become one."""
    lines = F.transform(F.split(F.replace(text, F.lit("\x00"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    begun = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("recent"), F.lit(True).alias("blank"))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(x)
        blank = F.struct(F.when(acc["blank"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.lit("")))).alias("out"), acc["recent"].alias("recent"), F.lit(True).alias("blank"))
        recent = F.concat(F.when(F.size(acc["recent"]) < reach, acc["recent"]).otherwise(F.slice(acc["recent"], 2, max(reach - 1, 1))), F.array(low))
        kept = F.struct(F.concat(acc["out"], F.array(x)).alias("out"), recent.alias("recent"), F.lit(False).alias("blank"))
        return F.when(x == "", blank).when(F.array_contains(acc["recent"], low), acc).otherwise(kept)

    return F.regexp_replace(F.array_join(F.aggregate(lines, begun, step)["out"], "\n"), r"\n+$", "")


def quality_status(issues: Column) -> Column:
    """fail with a critical issue, warning with any, else pass."""
    return F.when(F.exists(issues, lambda i: i == "critical"), "fail").when(F.size(issues) > 0, "warning").otherwise("pass")


def presentations(pages: DataFrame, key: str, words: str, title: str, pictures: str) -> DataFrame:
    """(key, n_pages, is_presentation): at least three pages, 60 per cent of at most 160 words, and 0.3 pictures a page or one title
    on a quarter of them. Titles are counted before the rows of a document meet."""
    per_title = pages.groupBy(key, F.lower(F.trim(F.regexp_replace(title, r"\s+", " "))).alias("_title")).agg(
        F.count("*").alias("n"), F.count_if(F.col(words) <= 160).alias("short"), F.sum(pictures).alias("pictures"))
    named = F.max(F.when(F.col("_title") != "", F.col("n")))
    whole = per_title.groupBy(key).agg(F.sum("n").alias("n_pages"), F.sum("short").alias("short"), F.sum("pictures").alias("pictures"), F.coalesce(named, F.lit(0)).alias("same"))
    n = F.col("n_pages")
    return whole.select(key, "n_pages", ((n >= 3) & (10 * F.col("short") >= 6 * n) & ((10 * F.coalesce("pictures", F.lit(0)) >= 3 * n) | (4 * F.col("same") >= n))).alias("is_presentation"))


def document_kind(text: Column, n_tables: Column, presentation: Column, letter: Sequence[str] = LETTER_MARKS, schema: Sequence[str] = SCHEMA_MARKS) -> Column:
    """technical_schema, administrative(_with_tables), presentation, mixed_with_tables or general, the first that fits."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    count = lambda marks: sum((F.contains(low, F.lit(m)).cast("int") for m in marks), F.lit(0))
    tables = F.coalesce(n_tables, F.lit(0)) > 0
    kind = F.when(count(schema) == len(schema), "technical_schema").when((count(letter) >= 2) & tables, "administrative_with_tables").when(count(letter) >= 2, "administrative")
    return kind.when(F.coalesce(presentation, F.lit(False)), "presentation").when(tables, "mixed_with_tables").otherwise("general")


def segment_strategy(kind: Column, has_table: Column, continues: Column, table_name: Column) -> Column:
    """How a record is cut, by its document's kind and its own tables."""
    of_table = F.when(F.coalesce(continues, F.lit(False)), "cross_page_table").when(F.coalesce(table_name != "", F.lit(False)) | (kind == "technical_schema"), "schema_table").otherwise("table_row_group")
    return F.when(kind == "presentation", "presentation_page").when(F.coalesce(has_table, F.lit(False)), of_table).when(F.startswith(kind, F.lit("administrative")), "administrative_section").otherwise("docling_hybrid")


def file_kind(name: Column, mime: Column, sheets: Sequence[str] = ("xls", "xlsx", "csv", "tsv", "ods"), slides: Sequence[str] = ("ppt", "pptx", "odp")) -> Column:
    """spreadsheet or slide by extension or by MIME type, else null."""
    end, low = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]+)$", 1)), F.lower(F.coalesce(mime, F.lit("")))
    return F.when(end.isin(*sheets) | low.rlike("spreadsheet|excel|csv"), "spreadsheet").when(end.isin(*slides) | low.rlike("presentation|powerpoint"), "slide")


def catalog_rows(lines: DataFrame, key: str, order: str, line: str, group: str, item: str) -> DataFrame:
    """(key, number, group, content): numbered lines (groups 1 and 2 of ``item``) under the last line that matches ``group``, each number,
    group and text once, the first one."""
    w = Window.partitionBy(key).orderBy(order)
    carried = lines.withColumn("group", F.last(F.when(F.col(line).rlike(group), F.trim(line)), ignorenulls=True).over(w)).filter(F.col(line).rlike(item))
    rows = carried.select(key, order, "group", F.regexp_extract(line, item, 1).cast("long").alias("number"), F.trim(F.regexp_extract(line, item, 2)).alias("content"))
    return rows.groupBy(key, "number", "group", "content").agg(F.min(order).alias(order))


def catalog_groups(rows: DataFrame, key: str, order: str, shown: int = 30) -> DataFrame:
    """(key, group, n_items, listing): one record a group, with its first ``shown`` items; n_items counts all. Windows rank before lists are made."""
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy(key, "group").orderBy(order, "number", "content")))
    item = F.when(F.col("at") <= shown, F.struct("at", F.concat(F.col("number").cast("string"), F.lit(". "), F.col("content")).alias("t")))
    return ranked.groupBy(key, "group").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), "\n").alias("listing"))


def page_support(sections: DataFrame, pages: DataFrame, key: str, section: str, page: str, least: float = 0.08) -> DataFrame:
    """(key, section, pages): pages that share at least ``least`` of a section's distinct tokens, else all pages of the document.

    Tokens meet by (document, token), so neither side's texts are compared pair by pair."""
    words = lambda d, *keep: d.select(*keep, F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("w"))
    own = words(sections, key, section)
    size = own.groupBy(key, section).agg(F.count("*").alias("n"))
    shared = own.join(words(pages, key, page), [key, "w"]).groupBy(key, section, page).agg(F.count("*").alias("both"))
    good = shared.join(size, [key, section]).filter(F.col("both") >= least * F.col("n")).groupBy(key, section).agg(F.array_sort(F.collect_set(page)).alias("good"))
    every = pages.groupBy(key).agg(F.array_sort(F.collect_set(page)).alias("all"))
    return sections.select(key, section).join(good, [key, section], "left").join(every, key, "left").select(key, section, F.coalesce("good", "all").alias("pages"))


def first_planned(rows: DataFrame, group: str, order: str, planned: Column, most: int) -> DataFrame:
    """``calls``: whether a planned row is among the first ``most`` planned ones of its group; the others are skipped, none goes."""
    rank = F.row_number().over(Window.partitionBy(group, "_planned").orderBy(order))
    marked = rows.withColumn("_planned", F.coalesce(planned, F.lit(False)))
    return marked.withColumn("calls", F.col("_planned") & (rank <= most)).drop("_planned")
