"""Queries over tables in text, layout passes, rule enrichment and query contracts, each with SQL of its own.

Lines of ``documents`` stand for layout records: patterns and page numbers are given by fixed rules, in the query and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enrich
from ..functions import question as Q
from ..operators import layout, tables
from .more import _CHUNKS, chunks
from .queries import query, table

_LINES = "(SELECT doc_id, (n - 1)::BIGINT AS line_no, line, (n - 1) // 3 AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"
_CODES = r"(?:^|[^\p{L}\p{N}_])(\d{2,6})\s*/\s*([\p{L}0-9][\p{L}0-9_/-]{2,})"
_SUFFIX = f"regexp_replace(unnest(regexp_extract_all(text, '{_CODES}', 2)), '[/-]+$', '')"
_FOUND = rf"""(SELECT doc_id, v, k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_CODES}', 1)) || '/' || {_SUFFIX} AS v, 'code' AS k, {_SUFFIX} AS s FROM documents) WHERE regexp_matches(s, '\p{{L}}') AND len(s) >= 3
UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_/])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(\d{{1,2}}/\d{{1,2}}/\d{{4}})(?:$|[^\p{{L}}\p{{N}}_])', 1)), 'date' FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(\d{{3,8}})(?:$|[^\p{{L}}\p{{N}}_])', 1)), 'number' FROM documents)"""
_N_MARKS = f"(SELECT doc_id, count(DISTINCT lower(v)) AS n FROM {_FOUND} GROUP BY doc_id)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", F.floor(F.col("line_no") / 3).alias("page"))


@query(r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+')), 0)::BIGINT AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", enrich.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-zÀ-ỹ0-9_/+.:-]+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN -50.0 ELSE len(w) - 3.0 * len(list_filter(w, lambda x: regexp_full_match(x, '\p{L}'))) - 8.0 * len(regexp_extract_all(text, '<!--|\x00'))
  - 2.5 * len(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])[A-Za-zÀ-ỹ]{1,3}\s+[À-ỹ](?:$|[^\p{L}\p{N}_])'))
  - 3.0 * len(regexp_extract_all(text, '(?i)(?:GIS|CSDL|CMIS|TTHT)[a-zà-ỹ]|[a-zà-ỹ](?:GIS|CSDL|CMIS|TTHT)')) END::DOUBLE AS score FROM t""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", enrich.text_quality(F.col("text")).alias("score"))


@query(f"SELECT doc_id, string_agg(DISTINCT lower(v), ' ' ORDER BY lower(v)) FILTER (k = 'code') AS codes, string_agg(DISTINCT v, ' ' ORDER BY v) FILTER (k = 'date') AS dates, count(DISTINCT lower(v)) AS n_identifiers FROM {_FOUND} GROUP BY doc_id")
def rule_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("long")
    e = table(spark, sf_dir, "documents").select("doc_id", enrich.by_rules(F.col("text"), F.col("source"), none, none).alias("e")).filter(F.size("e.identifiers") > 0)
    joined = lambda c: F.nullif(F.array_join(F.array_sort(c), " "), F.lit(""))
    return e.select("doc_id", joined(F.transform("e.doc_codes", lambda c: F.lower(c))).alias("codes"), joined(F.col("e.dates")).alias("dates"), F.size("e.identifiers").cast("long").alias("n_identifiers"))


_PLAN = rf"""(SELECT c.doc_id, source, CASE WHEN len(trim(text)) = 0 THEN 'empty_content' WHEN chunk_type = 'footer' THEN 'footer_or_non_indexable' WHEN NOT coalesce(indexable, true) OR NOT embedding_enabled THEN 'non_indexable'
  WHEN quality_status = 'Failed' THEN 'failed_quality' WHEN c.doc_id % 13 = 0 THEN 'profile_required' WHEN chunk_type = 'table_row' THEN 'structured_chunk_type' WHEN len(trim(text)) < 300 AND coalesce(n, 0) > 0 THEN 'short_with_codes' WHEN coalesce(n, 0) >= 3 THEN 'many_identifiers'
  WHEN c.doc_id % 17 = 0 THEN 'legal_structure' WHEN c.doc_id % 3 >= 2 THEN 'important_entities' WHEN c.doc_id % 19 = 0 THEN 'low_self_contained_score' WHEN len(trim(text)) >= 300 AND lang = 'en' THEN 'clear_prose_with_section_path' ELSE 'selective_no_trigger' END AS reason
  FROM {_CHUNKS} c LEFT JOIN {_N_MARKS} m ON m.doc_id = c.doc_id)"""
_NEEDED = "reason IN ('profile_required', 'structured_chunk_type', 'short_with_codes', 'many_identifiers', 'legal_structure', 'important_entities', 'low_self_contained_score')"


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, none = chunks(spark, sf_dir), F.col("doc_id"), F.lit(None).cast("long")
    rules = enrich.by_rules(F.col("text"), F.col("source"), none, none)
    need = enrich.needs_model(
        F.col("text"), F.col("chunk_type"), rules, F.coalesce("indexable", F.lit(True)) & F.col("embedding_enabled"), F.col("quality_status"), k % 13 == 0, k % 17 == 0, k % 3,
        F.when(k % 19 == 0, 0.5), F.when(F.col("lang") == "en", "a > b"))
    return c.select("doc_id", "source", need.alias("p")).select("doc_id", "source", "p.needed", "p.reason")


@query(f"SELECT doc_id, {_NEEDED} AS needed, reason FROM {_PLAN}")
def enrichment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks a model is to enrich, and by which rule."""
    return _planned(spark, sf_dir).select("doc_id", "needed", "reason")


@query(f"SELECT doc_id, {_NEEDED} AND row_number() OVER (PARTITION BY source, {_NEEDED} ORDER BY doc_id) <= 20 AS calls FROM {_PLAN}")
def enrichment_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a limit: twenty model calls a source, the first planned ones; the other rows are kept and skip the call."""
    return layout.first_planned(_planned(spark, sf_dir), "source", "doc_id", F.col("needed"), 20).select("doc_id", "calls")


@query("SELECT doc_id, sha256(to_json({'content': text, 'context': {'lang': lang, 'source': source}, 'model': 'm', 'prompt_version': 'p1', 'version': 'v1'})::VARCHAR) AS key FROM documents")
def enrichment_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", enrich.cache_key(F.col("text"), F.struct("lang", "source"), "v1", "m", "p1").alias("key"))


@query("SELECT doc_id, sha256('LLM enrichment:' || chr(10) || 'Tóm tắt: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Ngày ban hành: ' || lang ELSE '' END) AS digest FROM documents")
def enriched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = enrich.labelled({"issued_date": F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "summary": F.col("source"), "keywords": F.lit(" ")})
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query("""SELECT doc_id, sha256(array_to_string(list_filter([array_to_string(list_filter([CASE WHEN NOT contains(lower(text), lang) THEN 'Language: ' || lang END, CASE WHEN NOT contains(lower(text), source) THEN 'Source: ' || source END], lambda x: x IS NOT NULL), chr(10)),
  trim(text, ' '), CASE WHEN doc_id % 2 = 0 THEN 'more' END], lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM documents""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = enrich.embedding_text(F.col("text"), {"Language": F.col("lang"), "Source": F.col("source")}, F.when(F.col("doc_id") % 2 == 0, "more"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query(f"""SELECT doc_id, concat_ws('+', 'base', CASE WHEN chunk_type IN ('table_row', 'table_header') THEN 'row' END, CASE WHEN contains(lower(text), 'apache') AND chunk_type <> 'x' THEN 'license' END) AS roles,
  CASE WHEN contains(lower(text), 'apache') THEN 2 WHEN chunk_type IN ('table_row', 'table_header') THEN 5 END::BIGINT AS priority FROM {_CHUNKS}""")
def chunk_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"role": "row", "kinds": ["table_row", "table_header"], "priority": 5}, {"role": "license", "terms": ["Apache"], "priority": 2}, {"role": "base"}]
    r = enrich.with_roles(F.col("chunk_type"), F.col("text"), F.array(F.lit("base")), F.lit(None).cast("long"), rules)
    return chunks(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", F.array_join("r.roles", "+").alias("roles"), "r.priority")


@query(rf"""WITH p AS (SELECT doc_id, line_no, line, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM {_LINES} WHERE contains(line, '|')),
r AS (SELECT doc_id, run, min(line_no) AS first_line, count(*) FILTER (NOT regexp_matches(line, '^[\s|:+-]*$')) AS n_rows, max(len(string_split(regexp_replace(trim(line, ' '), '^\||\|$', '', 'g'), '|'))) FILTER (NOT regexp_matches(line, '^[\s|:+-]*$')) AS width FROM p GROUP BY ALL)
SELECT doc_id, first_line, n_rows, width::BIGINT AS width FROM r WHERE n_rows >= 2""")
def table_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.blocks(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "first_line", F.size("rows").cast("long").alias("n_rows"), F.array_max(F.transform("rows", lambda r: F.size(r))).cast("long").alias("width"))


def _mode() -> Column:
    return F.concat(F.lit("M"), (F.col("l_suppkey") % 3).cast("string"))


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table an order: a row of cells for each line item, under a first row of names where the order's number is even."""
    cells = F.array(_mode(), "l_returnflag", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber").cast("string")).otherwise(""))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    head = F.array(F.array(F.lit("Mode"), F.lit("Flag"), F.lit("No")))
    return tables.with_headers(rows.withColumn("rows", F.when(F.col("l_orderkey") % 2 == 0, F.concat(head, "rows")).otherwise(F.col("rows"))))


_ORDER_ROWS = """t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber::VARCHAR ELSE '' END AS c3, ('M' || l_suppkey % 3) AS c1, l_returnflag AS c2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 3, l_returnflag) AS n FROM lineitem),
f AS (SELECT l_orderkey, max(CASE WHEN n = 1 THEN c1 END) AS f1, max(CASE WHEN n = 1 THEN c2 END) AS f2, max(CASE WHEN n = 1 THEN c3 END) AS f3, count(*) AS total FROM t GROUP BY 1),
h AS (SELECT f.l_orderkey, f.l_orderkey % 2 <> 0 AND any_value(f3) <> '' AND any_value(total) > 1 AND (bool_and(c1 <> f1) OR bool_and(c2 <> f2) OR coalesce(bool_and(CASE WHEN c3 <> '' THEN c3 <> f3 END), false)) AS own FROM f JOIN t ON t.l_orderkey = f.l_orderkey AND n BETWEEN 2 AND 4 GROUP BY f.l_orderkey),
j AS (SELECT t.*, coalesce(own, false) AS own, f1, f2, f3 FROM t JOIN f USING (l_orderkey) LEFT JOIN h USING (l_orderkey)),
k AS (SELECT *, n - own::INT AS i, CASE WHEN l_orderkey % 2 = 0 THEN ['Mode', 'Flag', 'No'] WHEN own THEN [f1, f2, f3] ELSE ['cell_1', 'cell_2', 'cell_3'] END AS h FROM j)"""


@query(f"""WITH {_ORDER_ROWS}
SELECT l_orderkey, i::BIGINT AS row_index, 'TABLE_ROW table_id=T' || l_orderkey || ' row=' || i || ' | ' || h[1] || ': ' || c1 || ' | ' || h[2] || ': ' || c2 || ' | ' || h[3] || ': ' || c3 AS content FROM k WHERE i > 0""")
def table_row_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_records(_order_tables(spark, sf_dir), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")), "l_orderkey")


@query(f"""WITH {_ORDER_ROWS}
SELECT DISTINCT l_orderkey, 'table_header' AS chunk_type, 'TABLE_HEADER table_id=T' || l_orderkey || ' | ' || array_to_string(h, ' | ') AS content FROM k
UNION ALL SELECT DISTINCT l_orderkey, 'table_title', 'TABLE_TITLE table_id=T' || l_orderkey || ': Order ' || l_orderkey FROM k WHERE l_orderkey % 3 = 0""")
def table_supporting_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit(" Order  "), F.col("l_orderkey").cast("string")))
    return tables.supporting_records(_order_tables(spark, sf_dir), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")), title, "l_orderkey")


@query(f"""WITH RECURSIVE {_ORDER_ROWS},
s AS (SELECT l_orderkey, i AS n, len(regexp_extract_all(concat_ws(' | ', c1, c2, c3), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+')) AS s FROM k WHERE i > 0),
g AS (SELECT l_orderkey, n, 1 AS part, 5 + s AS total FROM s WHERE n = 1
  UNION ALL SELECT s.l_orderkey, s.n, part + (total + s > 18)::INT, CASE WHEN total + s > 18 THEN 5 + s ELSE total + s END FROM g JOIN s ON s.l_orderkey = g.l_orderkey AND s.n = g.n + 1)
SELECT l_orderkey, part::BIGINT AS part, min(n) AS first_row, max(n) AS last_row, max(total)::BIGINT AS n_tokens FROM g GROUP BY ALL""")
def table_token_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parts(_order_tables(spark, sf_dir), 18, "l_orderkey")


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_linenumber * 10 + l_suppkey % 3 * 2 + (l_quantity < 25)::INT AS pos, CASE WHEN l_quantity < 25 THEN 'M' || l_suppkey % 3 END AS mode FROM lineitem),
g AS (SELECT *, sum((coalesce(p, -9) < l_linenumber - 1)::INT) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY pos) AS group_no FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY pos) AS p FROM r))
SELECT l_orderkey, pos, group_no::BIGINT AS group_no, last_value(mode IGNORE NULLS) OVER (PARTITION BY l_orderkey, l_returnflag, group_no ORDER BY pos) AS mode FROM g""")
def table_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers stand for pages; equal places have equal values, so that ties change nothing."""
    low = F.col("l_quantity") < 25
    at = F.col("l_linenumber") * 10 + F.col("l_suppkey") % 3 * 2 + low.cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", at.alias("pos"), F.when(low, _mode()).otherwise(" ").alias("mode"))
    return tables.continued(rows, "l_orderkey", "l_returnflag", "pos", "l_linenumber", "mode").select("l_orderkey", "pos", "group_no", "mode")


_PARENTS = "(SELECT l_orderkey, min_by(('M' || l_suppkey % 3), l_linenumber) AS name, count(*) AS n_parts, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS fields, min(l_partkey) AS first_row, max(l_suppkey) AS last_row FROM lineitem GROUP BY l_orderkey, lower(('M' || l_suppkey % 3)) HAVING count(*) > 1)"


@query(f"SELECT * FROM {_PARENTS}")
def table_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", _mode().alias("name"), "l_linenumber", F.array("l_returnflag").alias("fields"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return tables.parents(parts, "l_orderkey", "name", "l_linenumber", "fields", "a", "b").withColumn("fields", F.array_join("fields", "+"))


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l LEFT JOIN lineitem p ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = 1 WHERE l.l_linenumber > 1 AND coalesce(l.l_suppkey % 3 <> p.l_suppkey % 3, true)")
def misfiled_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _mode().alias("name"))
    children = rows.filter("l_linenumber > 1").withColumn("parent", F.col("l_orderkey"))
    return tables.misfiled(children, rows.filter("l_linenumber = 1"), "parent", "l_orderkey", "name").select("l_orderkey", "l_linenumber")


_ARTICLE, _CHAPTER = r"^([A-Z])e (.*)$", r"^(Th|De)[a-z]+ "


@query(rf"""WITH l AS {_LINES}, m AS (SELECT *, regexp_matches(line, '{_ARTICLE}') AS a, regexp_matches(line, '{_CHAPTER}') AS c FROM l),
w AS (SELECT *, last_value(CASE WHEN c THEN regexp_extract(line, '{_CHAPTER}', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chapter,
  min(CASE WHEN a OR c THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, count(*) OVER (PARTITION BY doc_id) AS n FROM m)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS article_no, regexp_extract(line, '{_ARTICLE}', 1) AS number, chapter, line_no AS first_line, coalesce(nxt, n)::BIGINT AS until_line,
  (SELECT sum(len(line)) + count(*) - 1 FROM l WHERE l.doc_id = w.doc_id AND l.line_no >= w.line_no AND l.line_no < coalesce(nxt, n))::BIGINT AS n_chars FROM w WHERE a""")
def article_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.articles(table(spark, sf_dir, "documents"), _ARTICLE, _CHAPTER)
    return found.select("doc_id", "article_no", "number", "chapter", "first_line", "until_line", F.length("content").cast("long").alias("n_chars"))


@query(rf"""SELECT doc_id FROM documents d WHERE (SELECT count(*) FROM {_LINES} l WHERE l.doc_id = d.doc_id AND regexp_matches(line, '{_ARTICLE}')) >= 2
AND (contains(lower(text), 'apache') OR EXISTS (SELECT 1 FROM {_LINES} l WHERE l.doc_id = d.doc_id AND regexp_matches(line, '{_CHAPTER}')))""")
def legal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(layout.is_legal(F.col("text"), _ARTICLE, _CHAPTER, ["apache"], 2)).select("doc_id")


@query(f"""WITH l AS (SELECT *, len(line) < 40 AS lead FROM {_LINES}), j AS (SELECT *, coalesce(lead AND lag(lead) OVER w AND abs(page - lag(page) OVER w) <= 1, false) AS joins FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
c AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS chain FROM j)
SELECT doc_id, max(line_no) AS line_no, count(*) AS n_joined, min(page)::BIGINT AS first_page, max(page)::BIGINT AS last_page, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM c GROUP BY doc_id, chain""")
def heading_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = layout.collapse_leads(records(spark, sf_dir), "doc_id", "line_no", F.length("line") < 40, "page", "line")
    return done.select("doc_id", "line_no", "n_joined", "first_page", "last_page", F.sha2("line", 256).alias("digest"))


@query(rf"""WITH l AS (SELECT *, lower(regexp_extract(line, '^([A-Za-z]+)', 1)) AS section FROM {_LINES}), h AS (SELECT doc_id, section, min_by(line, line_no) AS resolved FROM l WHERE section <> '' GROUP BY ALL)
SELECT r.doc_id, line_no, reference, resolved FROM (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, ' (en[a-z]+|th[a-z]+)', 1)) AS reference FROM l) r LEFT JOIN h ON h.doc_id = r.doc_id AND h.section = reference""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("section", F.lower(F.regexp_extract("line", r"^([A-Za-z]+)", 1)))
    return layout.cross_references(r, "doc_id", "line_no", "section", "line", r" (en[a-z]+|th[a-z]+)").select("doc_id", "line_no", "reference", "resolved")


@query(r"""SELECT doc_id, suffix, string_agg(DISTINCT prefix, ' ' ORDER BY prefix) AS prefixes FROM (SELECT doc_id, unnest(regexp_extract_all(text, ' ([a-z])([A-Za-z]{3})\b', 1)) AS prefix, lower(unnest(regexp_extract_all(text, ' ([a-z])([A-Za-z]{3})\b', 2))) AS suffix FROM documents) GROUP BY ALL HAVING count(DISTINCT prefix) > 1""".replace(r"\b", "[ .,]"))
def identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.conflicts(table(spark, sf_dir, "documents"), pattern=r" ([a-z])([A-Za-z]{3})[ .,]")
    return found.select("doc_id", "suffix", F.array_join("prefixes", " ").alias("prefixes"))


@query(r"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
r AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS recent, true AS blank, NULL::VARCHAR AS kept FROM (SELECT DISTINCT doc_id FROM l)
UNION ALL SELECT doc_id, i, CASE WHEN x = '' OR again THEN recent ELSE list_append(recent, lower(x))[-12:] END, CASE WHEN x = '' THEN true WHEN again THEN blank ELSE false END, CASE WHEN x = '' THEN CASE WHEN NOT blank THEN '' END WHEN NOT again THEN x END
  FROM (SELECT l.*, r.recent, r.blank, list_contains(r.recent, lower(l.x)) AS again FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)),
k AS (SELECT doc_id, regexp_replace(coalesce(string_agg(kept, chr(10) ORDER BY i), ''), '\n+$', '') AS kept FROM r GROUP BY doc_id)
SELECT doc_id, length(kept)::BIGINT AS n_chars, sha256(kept) AS digest FROM k""")
def recent_line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without lines that equal one of the last twelve kept."""
    kept = layout.without_recent(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(kept).cast("long").alias("n_chars"), F.sha2(kept, 256).alias("digest"))


@query(f"""WITH p AS (SELECT doc_id, len(regexp_extract_all(line, '[^ ]+')) AS words, lower(regexp_extract(line, '^([A-Za-z]+)', 1)) AS title, (line_no % 5 = 0)::INT AS pictures FROM {_LINES}),
t AS (SELECT doc_id, max(n) FILTER (title <> '') AS same FROM (SELECT doc_id, title, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1), s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (words <= 160) AS short, sum(pictures) AS pics FROM p GROUP BY 1)
SELECT s.doc_id, n AS n_pages, n >= 3 AND 10 * short >= 6 * n AND (10 * pics >= 3 * n OR 4 * coalesce(same, 0) >= n) AS is_presentation FROM s JOIN t USING (doc_id)""")
def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records(spark, sf_dir).select("doc_id", F.size(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0))).alias("words"), F.regexp_extract("line", r"^([A-Za-z]+)", 1).alias("title"), (F.col("line_no") % 5 == 0).cast("int").alias("pictures"))
    return layout.presentations(p, "doc_id", "words", "title", "pictures")


_KIND = """CASE WHEN contains(lower(text), 'apache') AND contains(lower(text), 'license') THEN 'technical_schema' WHEN marks >= 2 AND doc_id % 3 > 0 THEN 'administrative_with_tables' WHEN marks >= 2 THEN 'administrative' WHEN doc_id % 5 = 0 THEN 'presentation' WHEN doc_id % 3 > 0 THEN 'mixed_with_tables' ELSE 'general' END"""
_MARKED = "(SELECT doc_id, text, contains(lower(text), 'est')::INT + contains(lower(text), 'ieux')::INT + contains(lower(text), 'ung')::INT AS marks FROM documents)"


@query(f"""SELECT doc_id, kind, CASE WHEN kind = 'presentation' THEN 'presentation_page' WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'cross_page_table' WHEN doc_id % 7 = 0 OR kind = 'technical_schema' THEN 'schema_table' ELSE 'table_row_group' END
WHEN starts_with(kind, 'administrative') THEN 'administrative_section' ELSE 'docling_hybrid' END AS strategy FROM (SELECT doc_id, {_KIND} AS kind FROM {_MARKED})""")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", layout.document_kind(F.col("text"), k % 3, k % 5 == 0, ["est", "ieux", "ung"], ["apache", "license"]).alias("kind"))
    return d.withColumn("strategy", layout.segment_strategy(F.col("kind"), k % 4 == 0, k % 8 == 0, F.when(k % 7 == 0, "t")))


_ITEM, _GROUP = r"^[^0-9]*([0-9]{1,6})(.*)$", r"^[A-C]"
_CATALOG = rf"""(SELECT doc_id, number, "group", content, min(line_no) AS line_no FROM (SELECT doc_id, line_no, line, regexp_extract(line, '{_ITEM}', 1)::BIGINT AS number, trim(regexp_extract(line, '{_ITEM}', 2), ' ') AS content, g AS "group"
  FROM (SELECT *, last_value(CASE WHEN regexp_matches(line, '{_GROUP}') THEN trim(line, ' ') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM {_LINES}) WHERE regexp_matches(line, '{_ITEM}')) GROUP BY ALL)"""


@query(f"SELECT * FROM {_CATALOG}")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.catalog_rows(records(spark, sf_dir), "doc_id", "line_no", "line", _GROUP, _ITEM)


@query(f"""SELECT doc_id, "group", count(*) AS n_items, coalesce(string_agg(number || '. ' || content, chr(10) ORDER BY n) FILTER (n <= 2), '') AS listing FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "group" ORDER BY line_no, number, content) AS n FROM {_CATALOG}) GROUP BY doc_id, "group" """)
def catalog_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's length is the feature; n_items counts every row."""
    rows = layout.catalog_rows(records(spark, sf_dir), "doc_id", "line_no", "line", _GROUP, _ITEM)
    return layout.catalog_groups(rows, "doc_id", "line_no", 2)


@query(r"""WITH w AS (SELECT DISTINCT conv_id, turn, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM conversations), s AS (SELECT conv_id, turn, count(*) AS n FROM w WHERE role = 'assistant' GROUP BY ALL),
b AS (SELECT a.conv_id, a.turn, u.turn AS page, count(*) AS b FROM w a JOIN w u ON u.conv_id = a.conv_id AND u.w = a.w AND u.role = 'user' WHERE a.role = 'assistant' GROUP BY ALL),
g AS (SELECT conv_id, turn, string_agg(page::VARCHAR, ' ' ORDER BY page) AS good FROM b JOIN s USING (conv_id, turn) WHERE b >= 0.3 * n GROUP BY ALL), e AS (SELECT conv_id, array_to_string(list_sort(list(DISTINCT turn)), ' ') AS every FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT DISTINCT c.conv_id, c.turn, coalesce(good, every) AS pages FROM conversations c LEFT JOIN g USING (conv_id, turn) LEFT JOIN e ON e.conv_id = c.conv_id WHERE role = 'assistant'""")
def page_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for pages: the user's turns whose words an answer takes up."""
    c = table(spark, sf_dir, "conversations")
    found = layout.page_support(c.filter("role = 'assistant'").select("conv_id", "turn", "text"), c.filter("role = 'user'").select("conv_id", F.col("turn").alias("page"), "text"), "conv_id", "turn", "page", 0.3)
    return found.select("conv_id", "turn", F.array_join(F.transform("pages", lambda p: p.cast("string")), " ").alias("pages")).distinct()


def _has(words: str) -> str:
    return rf"regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


@query(rf"""WITH t AS (SELECT item_id, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS q, list_concat(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])([0-9]{{3,8}}(?:/[A-Za-z0-9._/-]+)?)', 1), regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-z]{{1,12}}[0-9]{{1,8}}[A-Za-z0-9._/-]*)', 1)) AS c FROM benchmark),
u AS (SELECT item_id, q, len(string_split(q, ' ')) AS n, least(len(list_distinct(list_transform(c, lambda x: lower(regexp_replace(x, '[.,;:!? ]+$', ''))))), 8) AS n_terms FROM t),
v AS (SELECT *, CASE WHEN n_terms > 0 AND n <= 8 THEN 'identifier_lookup' WHEN {_has(Q.PERSON_WORDS)} AND n >= 3 THEN 'person_assignment' WHEN {_has(Q.PROCEDURE_WORDS)} THEN 'procedure_lookup' WHEN {_has(Q.POLICY_WORDS)} THEN 'policy_rule_lookup' WHEN {_has(Q.TABLE_WORDS)} THEN 'table_lookup' ELSE 'general_summary' END AS intent FROM u)
SELECT item_id, intent, CASE WHEN {_has(Q.TABLE_OUTPUT)} OR intent IN ('person_assignment', 'table_lookup') THEN 'table' WHEN {_has(Q.REPORT_OUTPUT)} THEN 'report' ELSE 'short_fact' END AS shape, n_terms::BIGINT AS n_terms FROM v""")
def query_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items stand for questions."""
    c = table(spark, sf_dir, "benchmark").select("item_id", Q.contract(F.col("text")).alias("c"))
    return c.select("item_id", "c.intent", "c.shape", F.size("c.exact_terms").cast("long").alias("n_terms"))
