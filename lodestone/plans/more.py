"""Queries over the operators of access, classification, boosts and evidence, each with SQL of its own.

``documents`` stands for the chunk table: its key gives every row a type, flags and a table number by a fixed rule, in the
query and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import question as Q
from ..functions import sparse
from ..functions import text as T
from ..operators import access, boosts, evidence, filters, index, relational, retrieval
from .queries import LISTS, keyword_list, query, sparse_list, table

_TYPES = ("text", "table_row", "table_header", "table_title", "table_block", "entity_summary", "schema_field_row", "attribute_table_schema", "footer")
_KIND = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"
_CHUNKS = f"""(SELECT doc_id, text, source, lang, {_KIND} AS chunk_type, CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 <> 3 END AS indexable, doc_id % 10 <> 4 AS embedding_enabled,
  CASE WHEN doc_id % 11 = 0 THEN 'Failed' WHEN doc_id % 11 = 1 THEN 'pass' END AS quality_status, doc_id // 20 AS table_no, 'T' || (doc_id % 4) AS table_name FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        "doc_id", "text", "source", "lang",
        F.get(F.array(*map(F.lit, _TYPES)), (k % 9).cast("int")).alias("chunk_type"),
        F.when(k % 7 > 0, k % 7 != 3).alias("indexable"),
        (k % 10 != 4).alias("embedding_enabled"),
        F.when(k % 11 == 0, "Failed").when(k % 11 == 1, "pass").alias("quality_status"),
        F.floor(k / 20).alias("table_no"),
        F.concat(F.lit("T"), (k % 4).cast("string")).alias("table_name"),
    )


@query(f"""SELECT chunk_type, count(*) AS n FROM {_CHUNKS} WHERE coalesce(indexable, true) AND embedding_enabled AND lower(coalesce(quality_status, '')) NOT IN ('fail', 'failed', 'rejected')
AND chunk_type NOT IN ('administrative_footer', 'header_footer', 'empty', 'parse_error', 'footer') AND regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY chunk_type""")
def indexable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).filter(filters.indexable()).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM {_CHUNKS} WHERE coalesce(indexable, true) AND chunk_type NOT IN ('footer', 'text')")
def null_or_true_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).filter(filters.null_or_true("indexable") & filters.null_or_other("chunk_type", ["footer", "text"])).select("doc_id")


@query(f"""SELECT doc_id FROM {_CHUNKS} WHERE lang IN ('en', 'de') AND doc_id BETWEEN 10 AND 900 AND NOT chunk_type IN ('footer', 'entity_summary') AND NOT coalesce(quality_status, '') = 'Failed'
AND (source = 'src1' OR table_name IN ('T1', 'T2'))""")
def payload_must_should(spark: SparkSession, sf_dir: str) -> DataFrame:
    must = [filters.condition(F.col("lang"), ["en", "de"]), filters.condition(F.col("doc_id"), least=10, most=900)]
    must_not = [filters.condition(F.col("chunk_type"), ["footer", "entity_summary"]), filters.condition(F.col("quality_status"), ["Failed"])]
    should = [filters.condition(F.col("source"), ["src1"]), filters.condition(F.array("table_name"), ["T1", "T2"], listed=True)]
    return chunks(spark, sf_dir).filter(filters.payload(must, must_not, should)).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license') OR contains(lower(text), 'license apache') OR (contains(lower(text), 'license') AND contains(lower(text), 'apache'))
OR contains(lower(text), 'idiot')""")
def token_and_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(filters.any_term(F.col("text"), ["Apache License", "license apache", "idiot"], by_tokens=True)).select("doc_id")


_FOLDED = f"translate(translate(lower(text), '{T.MARKED}', '{T.BASES}'), 'đ', 'd')"


@query(f"""SELECT doc_id, CASE WHEN n > 0 THEN 3.0 + 8.0 * n / 3 ELSE 0.0 END AS boost FROM (
  SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all({_FOLDED}, '[a-z0-9]+')), ['apache', 'license', 'version'])) AS n FROM documents)""")
def enrichment_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", boosts.enrichment("la Apache license version", F.col("text")).alias("boost"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 = 4 AND doc_id % 3 = 0 THEN 0.0 WHEN NOT (contains(chunk_type, 'row') OR contains(chunk_type, 'table')) THEN 0.0
  WHEN n > 0 THEN 8.0 + 30.0 * n / 3 + 4.0 ELSE 0.0 END::DOUBLE AS boost FROM (
  SELECT doc_id, chunk_type, len(list_intersect(list_distinct(regexp_extract_all({_FOLDED}, '[a-z0-9]+')), ['apache', 'license', 'version'])) AS n FROM {_CHUNKS})""")
def structured_row_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, c = F.lit(None).cast("string"), chunks(spark, sf_dir)
    worth = boosts.structured_row("Apache license version", F.col("text"), F.col("chunk_type"), none, none, F.when(F.col("doc_id") % 3 == 0, 0.2).otherwise(0.9), ~F.col("embedding_enabled"))
    return c.select("doc_id", worth.alias("boost"))


@query(f"""SELECT doc_id, CASE WHEN table_name = 'T1' THEN 5.0 ELSE 0.0 END + CASE chunk_type WHEN 'attribute_table_schema' THEN 30.0 ELSE 0.0 END::DOUBLE AS boost FROM {_CHUNKS}""")
def schema_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", boosts.schema("How many fields are in table T1?", {"table_name": F.col("table_name")}, F.col("chunk_type")).alias("boost"))


@query(f"""SELECT doc_id, (CASE WHEN b > 0 THEN b ELSE -0.02 END)::DOUBLE AS boost FROM (SELECT doc_id, CASE WHEN contains(lower(text), '2024') THEN 50.0 ELSE 0.0 END
  + CASE WHEN doc_id % 50 = 1 THEN 50.0 ELSE 0.0 END + CASE WHEN doc_id % 20 = 1 THEN 12.0 ELSE 0.0 END AS b FROM documents)""")
def identifier_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    worth = boosts.identifier("2024", F.col("text"), F.when(k % 50 == 1, F.lit("A 2024/X")), F.when(k % 20 == 1, F.lit("Report of 2024")))
    return table(spark, sf_dir, "documents").select("doc_id", worth.alias("boost"))


@query(f"""SELECT doc_id, CASE WHEN NOT (p OR a) OR chunk_type IN ('table_block', 'entity_summary') THEN 0.0 ELSE p::INT * 2.0 + a::INT * 2.0 + (p AND a)::INT * 6.0 + (chunk_type = 'table_row')::INT * 3.0 END::DOUBLE AS boost
FROM (SELECT doc_id, chunk_type, contains({_FOLDED}, 'apache') AS p, contains({_FOLDED}, 'license') AS a FROM {_CHUNKS})""")
def membership_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.select("doc_id", boosts.membership("Apache", "License", F.col("text"), F.col("chunk_type"), F.lit(False)).alias("boost"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"


@query(f"""SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, len(list_intersect(list_distinct({_WORDS}), ['the', 'apache', 'of', 'license'])) / 4 AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 40""")
def token_overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return retrieval.top(d.select("doc_id", F.round(retrieval.overlap_rerank("The Apache of license", F.col("text")), 6).alias("score")), 40, F.desc("score"), F.col("doc_id"))


@query(f"""WITH r AS (SELECT doc_id, round(fused, 6) AS fused, round(score, 6) AS score, hit FROM (
  SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS fused, len(list_intersect(list_distinct({_WORDS}), ['the', 'apache'])) / 2 AS score,
    CASE WHEN contains(lower(text), '2024') THEN 50.0 ELSE -0.02 END AS hit FROM documents))
SELECT doc_id, fused, score FROM r ORDER BY hit DESC, score DESC, fused DESC, doc_id::VARCHAR LIMIT 30""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sort key of reranking: identifier boost, score, fused rank, key."""
    d = table(spark, sf_dir, "documents")
    score = F.round(retrieval.overlap_rerank("the Apache", F.col("text")), 6)
    hit = boosts.identifier("2024", F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    # A rank over all rows is a global order: here it is the given column by which candidates come, n_chars.
    order = d.select("doc_id", "n_chars").repartitionByRange(F.desc("n_chars"), "doc_id").sortWithinPartitions(F.desc("n_chars"), "doc_id").withColumn("part", F.spark_partition_id())
    before = order.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = order.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n_chars"), "doc_id"))).join(before, "part").select("doc_id", F.round(1.0 / (60 + F.col("at") + F.col("before")), 6).alias("fused"))
    rows = d.select("doc_id", score.alias("score"), hit.alias("hit")).join(rank, "doc_id")
    return retrieval.top(rows, 30, F.desc("hit"), F.desc("score"), F.desc("fused"), F.col("doc_id").cast("string")).select("doc_id", "fused", "score")


@query(f"""WITH {LISTS},
c AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(lower(text), 'apache') QUALIFY rank <= 60),
u AS (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS p, 0 AS pos, 'sparse' AS f FROM a UNION ALL SELECT doc_id, 0.5::DOUBLE / (60 + rank), 1, 'keyword' FROM b UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank), 2, 'exact' FROM c)
SELECT doc_id, round(sum(p), 6) AS fused, string_agg(f, '+' ORDER BY pos) AS flags FROM u GROUP BY doc_id""")
def three_channel_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches of the index: unit-length weights, keywords, and documents that contain a term."""
    docs = table(spark, sf_dir, "documents")
    exact = index.index_of(docs).keyword_scores(docs, [], ["apache"])
    lists = {"sparse": sparse_list(spark, sf_dir, 60), "keyword": keyword_list(spark, sf_dir, 60), "exact": retrieval.ranked(exact.select("doc_id"), 60, F.col("doc_id"))}
    return retrieval.fuse_channels(lists, "doc_id", {"keyword": 0.5}).select("doc_id", F.round("fused", 6).alias("fused"), "flags")


@query(f"""SELECT doc_id, source, rank::BIGINT AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE chunk_type WHEN 'text' THEN 1 WHEN 'table_block' THEN 4 WHEN 'table_row' THEN 8 ELSE 12 END, doc_id) AS rank
  FROM {_CHUNKS} WHERE chunk_type IN ('text', 'table_block', 'table_row', 'entity_summary') AND (contains(lower(text), 'apache license') OR (contains(lower(text), 'apache') AND contains(lower(text), 'license')))) WHERE rank <= 5""")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.entity_coverage(chunks(spark, sf_dir), ["Apache License"], 5, "source", "doc_id")
    return found.select("doc_id", "source", "rank")


@query(f"""SELECT doc_id, table_no, rank::BIGINT AS rank FROM (SELECT doc_id, table_no, row_number() OVER (PARTITION BY table_no ORDER BY coalesce(place, 0), doc_id) AS rank FROM (
  SELECT *, max(place) OVER (PARTITION BY table_no) AS best FROM (SELECT doc_id, table_no, CASE WHEN chunk_type IN ('table_title', 'table_header') THEN 0 WHEN contains(lower(text), 'apache') THEN 1 END AS place FROM {_CHUNKS}))
  WHERE place IS NOT NULL OR best IS NULL)""")
def table_neighbour_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.table_neighbours(chunks(spark, sf_dir), ["apache"], "table_no", "doc_id").select("doc_id", "table_no", "rank")


@query(f"""SELECT doc_id, table_no, row_number() OVER (PARTITION BY table_no ORDER BY place, doc_id) AS rank FROM (SELECT doc_id, table_no, CASE chunk_type WHEN 'table_title' THEN 0 WHEN 'table_header' THEN 1 WHEN 'table_row' THEN 2
  WHEN 'table_block' THEN CASE WHEN rows = 0 THEN 2 END WHEN 'entity_summary' THEN NULL ELSE 3 END AS place FROM (SELECT *, count(*) FILTER (chunk_type = 'table_row') OVER (PARTITION BY table_no) AS rows FROM {_CHUNKS})) WHERE place IS NOT NULL""")
def full_table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.whole_table(chunks(spark, sf_dir), "table_no", "doc_id").select("doc_id", "table_no", "rank")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 5 WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN 1 WHEN chunk_type = 'attribute_table_schema' THEN 2 WHEN chunk_type IN ('schema_field_row', 'table_row') THEN 9 ELSE 8 END AS priority FROM {_CHUNKS}""")
def schema_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rank = evidence.schema_rank(F.col("chunk_type"), F.when(k % 13 == 0, 5), k % 17 == 0, F.when(k % 19 == 0, F.lit("has")))
    return chunks(spark, sf_dir).select("doc_id", rank.alias("priority"))


@query("""SELECT doc_id FROM (SELECT doc_id, contains(lower(text), 'apache') AS hit, bool_or(contains(lower(text), 'apache')) OVER (PARTITION BY doc_id // 10) AS among FROM documents) WHERE hit OR NOT among""")
def identifier_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("asked", F.floor(F.col("doc_id") / 10))
    return evidence.with_identifier(d, " Apache? ", "asked").select("doc_id")


@query("""SELECT doc_id, (i - 1)::INT AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
WHERE contains(lines[i], '|') AND (contains(lower(lines[i]), 'der') OR contains(lower(lines[i]), 'the'))""")
def table_row_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.row_evidence(table(spark, sf_dir, "documents"), ["der", "the"], "doc_id")


@query("""SELECT source, bool_or(contains(lower(text), 'apache license')) AS sufficient FROM documents GROUP BY source""")
def entity_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.names_entity(table(spark, sf_dir, "documents"), ["Apache License"], "source")


@query("""SELECT conv_id, 'Question: ' || first(text ORDER BY turn) || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || turn_no || '] ' || text, chr(10) ORDER BY turn_no) AS prompt
FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations) GROUP BY conv_id""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("said"))
    return turns.select("conv_id", evidence.prompt(F.get("said", F.lit(0)), F.col("said"), [("Memory", F.lit(""))]).alias("prompt"))


@query("""SELECT doc_id, substr(text, 1, 500) AS quote, try_cast(CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id ELSE doc_id::VARCHAR END AS INT) AS page FROM documents""")
def citation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("page", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")))
    return evidence.citations(d).select("doc_id", "quote", "page")


def _sql_any(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(' ' || {column} || ' ', ' {t} ')" if len(t) <= 3 else f"contains({column}, '{t}')" for t in terms) + ")"


_PLAIN = f"trim(regexp_replace(translate(translate(lower(text), '{T.MARKED}', '{T.BASES}'), 'đ', 'd'), '\\s+', ' ', 'g'))"
_CASES = ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, hit in (
    ("exact_lookup", f"({_sql_any('q', Q.EXACT_LOOKUP)} OR regexp_matches(text, '(?i)\\b[0-9]{{1,6}}\\s*/\\s*[A-ZĐ0-9][A-ZĐ0-9_/-]+\\b'))"), ("overview_summary", _sql_any("q", Q.OVERVIEW)), ("count_list", _sql_any("q", Q.COUNT_LIST)), ("table_detail", _sql_any("q", Q.TABLE_DETAIL)),
    ("comparison", _sql_any("q", Q.COMPARISON)), ("procedure", _sql_any("q", Q.PROCEDURE)), ("calculation", _sql_any("q", Q.CALCULATION)),
    ("multi_hop", f"({_sql_any('q', Q.MULTI_HOP)} OR ({_sql_any('q', Q.OVERVIEW)} AND {_sql_any('q', Q.COUNT_LIST)}))"),
))


@query(f"""SELECT conv_id, turn, coalesce(nullif(array_to_string(list_filter([{_CASES}], lambda x: x IS NOT NULL), ','), ''), 'semantic_search') AS strategies FROM (SELECT conv_id, turn, text, {_PLAIN} AS q FROM conversations)""")
def query_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of every message, as many as apply."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(Q.strategies(F.col("text")), ",").alias("strategies"))


_REWRITE = f"trim(regexp_replace(regexp_replace(translate(translate(lower(text), '{T.MARKED}', '{T.BASES}'), 'đ', 'd'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT conv_id, turn, q AS rewritten, q <> '' AND ({" OR ".join(f"contains(q, '{p}')" for p in Q.FOLLOW_UP)} OR (starts_with(q, 'con ') AND NOT starts_with(q, 'con nguoi')) OR regexp_matches(q, '\\b(thi sao|nua khong|tiep tuc|ke tiep)\\b')
  OR (len(string_split(q, ' ')) <= 6 AND (contains(q, 'sao') OR contains(q, 'nua') OR contains(q, 'tiep') OR contains(q, 'do') OR contains(q, 'nay')))) AS follow_up FROM (SELECT conv_id, turn, {_REWRITE} AS q FROM conversations)""")
def follow_up_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.rewrite_text(F.col("text")).alias("rewritten"), Q.follows_up(F.col("text")).alias("follow_up"))


_ASKS = {"that is": "instruction", "of the": "preference", "and in": "instruction", "is the": "preference"}


@query(f"""SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(lower(text), '{p}') THEN '{k}'" for p, k in _ASKS.items())} END AS kind, trim(text) AS content
FROM conversations WHERE role = 'user' AND ({" OR ".join(f"contains(lower(text), '{p}')" for p in _ASKS)})""")
def auto_saved_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of a user that asks to be remembered, by phrases that occur in these conversations."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("m", Q.remembered(F.col("text"), _ASKS))
    return rows.filter("m IS NOT NULL").select("conv_id", "turn", "m.kind", "m.content")


@query("""SELECT doc_id, sha256(text) AS content_sha256 FROM documents""")
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("content_sha256"))


@query()
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed sparse vectors of all documents (BLAKE2b has no SQL form: tests hold them against single texts)."""
    v = sparse.vectors(table(spark, sf_dir, "documents"))
    return v.select("doc_id", F.size("indices").alias("n_buckets"), F.xxhash64("indices").alias("indices_hash"))


@query()
def sparse_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 80 (four times the 20 asked for) by the dot product of hashed sparse vectors."""
    v = sparse.vectors(table(spark, sf_dir, "documents"))
    scored = v.select("doc_id", F.round(sparse.dot(F.col("indices"), F.col("values"), sparse.vector("the Apache license of 2024")), 6).alias("score")).filter("score > 0")
    return retrieval.top(scored, 80, F.desc("score"), F.col("doc_id"))


@query("""SELECT lang, n, sum(n) OVER (ORDER BY lang) AS running FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    return relational.running_total(counted, "all", "lang", "n").select("lang", "n", "running")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS subchunk FROM documents")
def subchunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""SELECT n_nationkey AS k, 'nation' AS side FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region""")
def union_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("side")).unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.lit("region").alias("side")))


@query("""SELECT name, side, k FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY side, k) AS n FROM (SELECT lower(n_name) AS name, 0 AS side, n_nationkey AS k FROM nation UNION ALL SELECT lower(r_name), 1, r_regionkey FROM region)) WHERE n = 1""")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.lit(0).alias("side"), F.col("n_nationkey").alias("k"))
    b = table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"), F.lit(1).alias("side"), F.col("r_regionkey").alias("k"))
    return relational.union_distinct(a, b, F.col("name"), "k")


@query("""SELECT l_suppkey AS source, l_linestatus AS type, l_returnflag AS target, max(l_discount)::DOUBLE AS confidence, count(*) AS n_found FROM lineitem GROUP BY ALL""")
def keep_best_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linestatus").alias("type"), F.col("l_returnflag").alias("target"), F.col("l_discount").cast("double").alias("confidence"))
    return relational.best_relations(edges)


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct([c_mktsegment, 'A', 'z b'])), '|') AS domains FROM customer""")
def access_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" z b ;A,"), F.col("c_mktsegment"), F.lit("| A ,"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(access.normal_list(raw), "|").alias("domains"))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    some = lambda n, at, value: F.when(k % n == at, F.array(F.lit(value)))
    scopes = ("corp_internal", "unit_only", "department_only", "functional_vertical", "project_only", "leadership_only", "explicit_acl")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (k % 5).cast("int").alias("classification"), F.get(F.array(*map(F.lit, scopes)), (k % 7).cast("int")).alias("scope"),
        F.concat(F.lit("o"), (k % 3).cast("string")).alias("owner_org_id"), F.when(k % 2 == 0, "/a/b").otherwise("/a").alias("owner_org_path"),
        F.when(k % 23 == 0, "u1").alias("uploaded_by"), F.when(k % 4 != 0, k % 4 == 1).alias("inherit_permission"),
        some(2, 1, "d1").alias("business_domains"), some(3, 1, "p1").alias("project_codes"),
        some(29, 0, "u1").alias("denied_users"), some(31, 0, "EDITOR").alias("denied_roles"), some(37, 0, "g1").alias("denied_groups"), some(41, 0, "o9").alias("denied_orgs"), some(43, 0, "/a").alias("denied_paths"),
        some(47, 0, "u1").alias("allowed_users"), some(13, 0, "EDITOR").alias("allowed_roles"), some(17, 0, "g1").alias("allowed_groups"), some(19, 0, "o9").alias("allowed_orgs"), some(11, 0, "/a/b").alias("allowed_paths"),
    )


_CASCADE = """SELECT c_custkey, CASE WHEN k % 29 = 0 THEN 'deny_user' WHEN k % 31 = 0 THEN 'deny_role' WHEN k % 37 = 0 THEN 'deny_group' WHEN k % 41 = 0 OR k % 43 = 0 THEN 'deny_org' WHEN k % 5 > 3 THEN 'classification'
  WHEN k % 47 = 0 THEN 'allow_user' WHEN k % 13 = 0 THEN 'allow_role' WHEN k % 17 = 0 THEN 'allow_group' WHEN k % 19 = 0 OR k % 11 = 0 THEN 'allow_org' WHEN k % 5 = 3 AND k % 4 IN (2, 3) THEN 'sensitive' WHEN k % 23 = 0 THEN 'owner'
  {rest} END AS policy, k % 3 = 1 AS org, k % 2 = 0 AS dept, k % 2 = 1 AS domain, k % 7 AS s FROM (SELECT c_custkey, c_custkey AS k FROM customer)"""


@query(f"""SELECT c_custkey, CASE WHEN starts_with(policy, 'deny') OR policy IN ('classification', 'sensitive') THEN false WHEN policy IS NOT NULL THEN true WHEN s = 0 THEN true WHEN s = 1 THEN true WHEN s = 2 THEN dept WHEN s = 3 THEN domain WHEN s = 4 THEN org WHEN s = 5 THEN true ELSE false END AS allowed,
  coalesce(policy, ['corp_internal', 'unit_only', 'department_only', 'functional_vertical', 'project_only', 'leadership_only', 'explicit_acl'][s + 1]) AS policy FROM ({_CASCADE.format(rest="")})""")
def access_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the cascade for one reader: denials, clearance, grants, sensitive classes, ownership, scopes."""
    who = access.Reader("u1", "o1", "/a/b", ["o9"], ["EDITOR"], ["g1"], ["d1"], ["p1"], "CHIEF", 3)
    rules = access.Rules(leadership_positions=("CHIEF",))
    return _resources(spark, sf_dir).select("c_custkey", access.cascade(who, "search", rules).alias("a")).select("c_custkey", "a.allowed", "a.policy")


@query(f"""SELECT c_custkey, CASE WHEN starts_with(policy, 'deny') OR policy IN ('classification', 'sensitive', 'action') THEN false ELSE true END AS allowed, policy FROM ({_CASCADE.format(rest="ELSE 'role_org'")})""")
def access_manage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting: owners and grants, and administrators within their organisation tree."""
    who = access.Reader("u1", "o1", "/a/b", ["o9"], ["EDITOR", "ADMIN"], ["g1"], ["d1"], ["p1"], "CHIEF", 3)
    return _resources(spark, sf_dir).select("c_custkey", access.cascade(who, "delete").alias("a")).select("c_custkey", "a.allowed", "a.policy")


@query("""WITH m AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), r AS (SELECT doc_id, try_cast(trim(string_split(regexp_replace(trim(x), '^\\|+', ''), '|')[1]) AS BIGINT) AS v FROM (SELECT doc_id, unnest(lines) AS x FROM m) WHERE starts_with(trim(x), '|'))
SELECT m.doc_id, min(v) AS first, max(v) AS last FROM m LEFT JOIN r ON m.doc_id = r.doc_id GROUP BY m.doc_id""")
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.row_range(F.col("text")).alias("r")).select("doc_id", "r.first", "r.last")
