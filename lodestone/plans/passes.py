"""Queries over passes through ordered records, each against recursive or windowed SQL.

Lines of ``documents`` stand for records: what is a heading, a table's name or a row number is given by fixed rules, in the query and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence_rows, expansion, graph, limits, records, tables
from ..sources.shared import shared_dir, stored
from ..streaming import jobs
from .queries import query, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line, word): every line and its first word, null where it begins with none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    word = F.nullif(F.regexp_extract("line", r"^\s*(\p{L}+)", 1), F.lit(""))
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", word.alias("word"))


_LINES = r"""SELECT doc_id, (n - 1)::BIGINT AS line_no, line, nullif(regexp_extract(line, '^\s*(\p{L}+)', 1), '') AS word FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""


@query(rf"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, line_no, CASE WHEN length(word) <= 4 THEN word END AS heading, nullif(length(line) % 5, 0) AS n,
  CASE WHEN contains(lower(line), 'licens') THEN 'License' END AS named, regexp_matches(lower(word), '^[ws]') AS closes FROM ({_LINES})),
k AS MATERIALIZED (SELECT *, coalesce(regexp_matches(lower(heading), '^[aeiou]'), false) AS object FROM l),
r AS (SELECT doc_id, (-1)::BIGINT AS line_no, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM (SELECT DISTINCT doc_id FROM k)
UNION ALL SELECT k.doc_id, k.line_no, r.after, CASE WHEN named IS NOT NULL THEN named WHEN object THEN CASE WHEN coalesce(n > 1, false) THEN coalesce(r.after, heading) ELSE heading END WHEN closes THEN NULL ELSE r.after END
  FROM r JOIN k ON k.doc_id = r.doc_id AND k.line_no = r.line_no + 1),
f AS (SELECT k.*, r.before, r.after, CASE
  WHEN named IS NOT NULL THEN CASE WHEN object AND lower(heading) <> lower(named) THEN 'replaced' END
  WHEN object THEN CASE WHEN coalesce(n > 1, false) AND r.before IS NOT NULL AND lower(heading) <> lower(r.before) THEN 'replaced' END
  WHEN heading IS NULL AND n IS NOT NULL AND r.before IS NOT NULL AND NOT coalesce(closes, false) THEN 'prefixed' END AS repair FROM k JOIN r ON k.doc_id = r.doc_id AND k.line_no = r.line_no)
SELECT doc_id, line_no, after AS current, CASE WHEN repair IS NULL THEN heading ELSE after END AS heading, repair FROM f""")
def stale_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of lines repaired by the table that is open: short first words are headings, those with a vowel first objects."""
    heading = F.when(F.length("word") <= 4, F.col("word"))
    named = F.when(F.contains(F.lower("line"), F.lit("licens")), F.lit("License"))
    object_ = F.rlike(F.lower(heading), F.lit("^[aeiou]"))
    rows = lines(spark, sf_dir).select("doc_id", "line_no", "word", F.nullif(F.length("line") % 5, F.lit(0)).alias("n"), named.alias("named"))  # not the lines themselves
    found = records.repaired_headings(rows, ["doc_id"], "line_no", heading, F.col("n"), object_, F.col("named"), F.rlike(F.lower("word"), F.lit("^[ws]")))
    return found.select("doc_id", "line_no", "current", "heading", "repair")


_PAIRS = rf"""SELECT doc_id, line_no // 2 AS record_no, string_agg(line, chr(10) ORDER BY line_no) AS text, arg_min(line, line_no) AS first FROM ({_LINES}) GROUP BY doc_id, line_no // 2"""
_CLEAN = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query(rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, record_no, text, len(regexp_extract_all(text, '\p{{L}}+')) BETWEEN 1 AND 30 AS lead, record_no // 5 AS page,
  CASE WHEN length(first) <= 120 THEN first END AS heading, coalesce(length(first) <= 120 AND regexp_matches(lower(first), '^[aeiou]'), false) AS object FROM ({_PAIRS})),
g AS MATERIALIZED (SELECT p.*, n.text AS next_text, n.doc_id IS NOT NULL AND p.lead AND n.page - p.page BETWEEN 0 AND 1 AS goes,
  coalesce({_CLEAN.format("p.heading")} = {_CLEAN.format("n.heading")}, false) OR p.object AND n.object AS drops FROM p LEFT JOIN p n ON n.doc_id = p.doc_id AND n.record_no = p.record_no + 1),
r AS (SELECT doc_id, record_no, goes AS merged FROM g WHERE record_no = 0
UNION ALL SELECT g.doc_id, g.record_no, g.goes AND NOT r.merged FROM r JOIN g ON g.doc_id = r.doc_id AND g.record_no = r.record_no + 1),
m AS (SELECT g.*, r.merged, coalesce(lag(r.merged) OVER (PARTITION BY g.doc_id ORDER BY g.record_no), false) AS taken,
  CASE WHEN drops THEN regexp_replace(next_text, '^\s*[^\n]*(\n|$)', '') ELSE next_text END AS rest FROM g JOIN r ON g.doc_id = r.doc_id AND g.record_no = r.record_no)
SELECT doc_id, record_no + merged::BIGINT AS record_no, sha256(CASE WHEN NOT merged THEN text WHEN rest <> '' THEN text || chr(10) || rest ELSE text END) AS digest, CASE WHEN merged THEN record_no END AS merged_from FROM m WHERE merged OR NOT taken""")
def heading_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short records, of two lines each, that go into the record after them."""
    at = F.floor(F.col("line_no") / 2)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    rows = lines(spark, sf_dir).groupBy("doc_id", at.alias("record_no")).agg(parts.alias("parts")).select("doc_id", "record_no", F.array_join("parts.line", "\n").alias("text"), F.get("parts.line", F.lit(0)).alias("first"))
    heading = F.when(F.length("first") <= 120, F.col("first"))
    found = records.leads_forward(rows, ["doc_id"], "record_no", "text", F.regexp_count("text", F.lit(r"\p{L}+")).between(1, 30), F.floor(F.col("record_no") / 5), heading, F.rlike(F.lower(heading), F.lit("^[aeiou]")))
    return found.select("doc_id", "record_no", F.sha2("text", 256).alias("digest"), "merged_from")


_LEVELS = "CASE WHEN lower(word) LIKE 'a%' THEN 1 WHEN regexp_matches(lower(word), '^[ei]') THEN 2 WHEN lower(word) LIKE 'o%' THEN 3 WHEN lower(word) LIKE 't%' THEN 4 END"
_OF = "max(CASE WHEN level = {0} THEN line_no END) OVER w AS at{0}, arg_max(word, line_no) FILTER (level = {0}) OVER w AS title{0}"
_IN = "CASE WHEN at{0} > greatest(-1, {1}) THEN title{0} END AS s{0}"


@query(rf"""WITH l AS (SELECT doc_id, line_no, word, {_LEVELS} AS level FROM ({_LINES})),
a AS (SELECT *, {", ".join(_OF.format(n) for n in range(1, 5))} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
s AS (SELECT *, {", ".join(_IN.format(n, ", ".join([f"coalesce(at{m}, -1)" for m in range(1, n)] or ["-1"])) for n in range(1, 5))} FROM a),
b AS (SELECT doc_id, line_no, {", ".join(f"lag(at{n}) OVER w AS b{n}, lag(title{n}) OVER w AS t{n}" for n in range(1, 5))} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
u AS (SELECT s.doc_id, s.line_no, level, unnest([1, 2, 3, 4]) AS n, unnest([b1, b2, b3, b4]) AS pos, unnest([t1, t2, t3, t4]) AS title FROM s JOIN b ON s.doc_id = b.doc_id AND s.line_no = b.line_no),
p AS (SELECT doc_id, line_no, arg_max(title, pos) AS parent FROM u WHERE pos IS NOT NULL AND (level IS NULL OR n < level) GROUP BY doc_id, line_no)
SELECT s.doc_id, s.line_no, concat_ws(' > ', s1, s2, s3, s4) AS path, parent FROM s LEFT JOIN p ON s.doc_id = p.doc_id AND s.line_no = p.line_no""")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path and the parent heading of every line; a line's level is given by its first letter."""
    first = lambda pattern: F.rlike(F.lower("word"), F.lit(pattern))
    level = F.when(first("^a"), 1).when(first("^[ei]"), 2).when(first("^o"), 3).when(first("^t"), 4)
    found = records.section_paths(lines(spark, sf_dir).drop("line"), ["doc_id"], "line_no", level, F.col("word"), levels=4)
    return found.select("doc_id", "line_no", F.array_join("path", " > ").alias("path"), "parent")


_LIMIT, _HARD = 120, 102


@query(rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, pairs, len(pairs) AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?:[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_\s]+)\s*') AS pairs FROM documents)),
m AS (SELECT doc_id, n, i, regexp_matches(before, '[.!?;:]\s*$') OR contains(regexp_extract(before, '\s*$'), chr(10)) AS ended, regexp_matches(pair, '^\p{{Ll}}') AS small FROM (
  SELECT doc_id, n, unnest(pairs) AS pair, unnest(list_prepend('', pairs[:-2])) AS before, generate_subscripts(pairs, 1) - 1 AS i FROM t)),
k AS MATERIALIZED (SELECT doc_id, n, i, max(CASE WHEN i > 0 AND ended AND NOT small THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS latest FROM m),
r AS (SELECT doc_id, n, 0::BIGINT AS part, 0::BIGINT AS a, CASE WHEN n <= {_LIMIT} THEN n ELSE 0 END::BIGINT AS z, n <= {_LIMIT} AS whole FROM t WHERE n > 0
UNION ALL SELECT r.doc_id, r.n, r.part + 1, r.z, CASE WHEN r.z + {_HARD} >= r.n THEN r.n WHEN k.latest > least(r.z + {_HARD} - 1, r.z + {int(_HARD * 0.55)}) THEN k.latest ELSE r.z + {_HARD} END::BIGINT, false
  FROM r LEFT JOIN k ON k.doc_id = r.doc_id AND k.i = r.z + {_HARD} WHERE r.z < r.n)
SELECT r.doc_id, part - CASE WHEN whole THEN 0 ELSE 1 END AS part, z - a AS n_tokens, sha256(regexp_replace(array_to_string(pairs[a + 1:z], ''), '\s+$', '')) AS digest FROM r JOIN t ON r.doc_id = t.doc_id WHERE z > a""")
def hard_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at tokens, at sentence and line ends where the last 45 per cent of a part have one."""
    found = limits.cut(table(spark, sf_dir, "documents"), _LIMIT)
    return found.select("doc_id", "part", "n_tokens", F.sha2("text", 256).alias("digest"))


@query(rf"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (
  SELECT l_orderkey, l_linenumber, sum(20 + l_partkey % 60)::BIGINT AS cost FROM lineitem GROUP BY l_orderkey, l_linenumber)),
p AS (SELECT l_orderkey, i, n, cost, 0 AS part, cost AS used FROM c WHERE i = 1
UNION ALL SELECT c.l_orderkey, c.i, c.n, c.cost, CASE WHEN 10 + p.used + c.cost > 150 THEN p.part + 1 ELSE p.part END, CASE WHEN 10 + p.used + c.cost > 150 THEN c.cost ELSE p.used + c.cost END FROM p JOIN c ON c.l_orderkey = p.l_orderkey AND c.i = p.i + 1),
s AS (SELECT l_orderkey, max(n) AS n, max(part) AS last, list(cost ORDER BY i) AS costs, list(part ORDER BY i) AS parts FROM p GROUP BY l_orderkey),
b AS (SELECT *, list_position(parts, last - 1) - 1 AS head, list_position(parts, last) - 1 AS tail FROM s WHERE last > 0),
t AS (SELECT l_orderkey, n, costs, head, tail, false AS done FROM b
UNION ALL SELECT l_orderkey, n, costs, head, CASE WHEN stop THEN tail ELSE tail - 1 END, stop FROM (
  SELECT *, tail - head <= 2 OR (n - tail >= 2 AND 10 + list_sum(costs[tail + 1:]) >= 72) OR 10 + list_sum(costs[head + 1:tail - 1]) > 150 OR 10 + list_sum(costs[tail:]) > 150 AS stop FROM t WHERE NOT done)),
e AS (SELECT l_orderkey, CASE WHEN n - tail >= 2 THEN tail WHEN 10 + list_sum(costs[head + 1:]) <= 150 THEN n WHEN tail - head > 2 THEN tail - 1 ELSE tail END AS tail, head FROM t WHERE done)
SELECT c.l_orderkey, c.l_linenumber, (CASE WHEN e.l_orderkey IS NULL OR c.i <= e.head THEN p.part WHEN c.i <= e.tail THEN s.last - 1 ELSE s.last END)::BIGINT AS part
FROM c JOIN p ON p.l_orderkey = c.l_orderkey AND p.i = c.i JOIN s ON s.l_orderkey = c.l_orderkey LEFT JOIN e ON e.l_orderkey = c.l_orderkey""")
def table_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order tables packed under a limit of 150 tokens with a header of 10, the last two parts evened out."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(20 + F.col("l_partkey") % 60).alias("cost"))
    return limits.rebalanced(rows, "l_orderkey", "l_linenumber", F.col("cost"), 150, fixed=10).select("l_orderkey", "l_linenumber", "part")


_SPACED = "regexp_replace(text, ', ', ',   ', 'g')"
_ROWS = rf"""SELECT doc_id, text, i, line, CASE WHEN contains(line, '|') THEN 'pipe' WHEN regexp_matches(line, '\S[ \t]{{2,}}\S') THEN 'aligned' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s') THEN 'more' ELSE 'text' END AS kind,
  (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1)::BIGINT AS start, NOT regexp_full_match(line, '[\s|:+-]*') AS filled FROM (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT doc_id, {_SPACED} AS text FROM documents))"""


@query(rf"""WITH RECURSIVE l AS MATERIALIZED ({_ROWS}),
r AS (SELECT doc_id, 0::BIGINT AS i, NULL::VARCHAR AS kind, 0 AS run, 0 AS blank, false AS member FROM (SELECT DISTINCT doc_id FROM l)
UNION ALL SELECT l.doc_id, l.i, CASE WHEN l.kind IN ('pipe', 'aligned') THEN l.kind WHEN r.kind = 'aligned' AND (l.kind = 'more' OR l.kind = 'blank' AND r.blank = 0) THEN r.kind END,
  r.run + CASE WHEN l.kind IN ('pipe', 'aligned') AND r.kind IS DISTINCT FROM l.kind THEN 1 ELSE 0 END, CASE WHEN l.kind = 'blank' THEN r.blank + 1 ELSE 0 END, l.kind IN ('pipe', 'aligned') OR r.kind = 'aligned' AND l.kind = 'more'
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
t AS MATERIALIZED (SELECT l.doc_id, r.kind, min(start) AS start, max(start + length(line)) AS z FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i WHERE member GROUP BY l.doc_id, r.kind, run
  HAVING CASE WHEN r.kind = 'pipe' THEN count(*) FILTER (filled) ELSE count(*) FILTER (l.kind = 'aligned') END >= 2),
n AS (SELECT doc_id, length({_SPACED})::BIGINT AS n FROM documents),
g AS (SELECT doc_id, coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY start, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, start AS z FROM (SELECT doc_id, start, z FROM t UNION ALL SELECT doc_id, n, n FROM n)),
p AS (SELECT doc_id, kind, start, z FROM t UNION ALL SELECT doc_id, 'prose', start, z FROM g WHERE z > start)
SELECT doc_id, kind, start, z AS "end", sha256(substr({_SPACED}, start + 1, z - start)) AS digest FROM p JOIN documents USING (doc_id)""")
def prose_minus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and the prose between them: the ranges of a document are disjoint and cover it. Wider gaps after commas make its lists columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", ", ", ",   ").alias("text"))
    return tables.prose_and_tables(docs).select("doc_id", "kind", "start", "end", F.sha2("part", 256).alias("digest"))


_NEAR = """SELECT h.doc_id AS asked, 1 AS hit, 0 AS stage, d.doc_id AS id, d.n_chars AS cost, contains(lower(d.text), 'apache') AS signal FROM q h JOIN documents d ON d.doc_id BETWEEN h.doc_id - 20 AND h.doc_id + 20 AND contains(lower(d.text), 'the')
UNION ALL SELECT h.doc_id, 1, 1, d.doc_id, d.n_chars, false FROM q h JOIN documents d ON d.doc_id BETWEEN h.doc_id + 1 AND h.doc_id + 9
UNION ALL SELECT h.doc_id, 1, 2, d.doc_id, d.n_chars, false FROM q h JOIN documents d ON d.doc_id BETWEEN h.doc_id - 12 AND h.doc_id - 1"""


@query(f"""WITH RECURSIVE q AS MATERIALIZED (SELECT doc_id, n_chars FROM documents WHERE doc_id % 50 = 0),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY hit, stage, id) AS n FROM ({_NEAR})),
r AS (SELECT doc_id AS asked, 0::BIGINT AS n, NULL::BIGINT AS id, n_chars::BIGINT AS used, [doc_id] AS seen, 0 AS added, false AS ended FROM q
UNION ALL SELECT asked, n, CASE WHEN fits THEN id END, CASE WHEN fits THEN used + cost ELSE used END, CASE WHEN fits THEN list_append(seen, id) ELSE seen END, added + (fits AND stage = 0)::INT, NOT held AND NOT fits AND stage > 0 FROM (
  SELECT c.*, r.used, r.seen, r.added, list_contains(r.seen, c.id) AS held, NOT list_contains(r.seen, c.id) AND (r.used + c.cost <= 6000 OR c.stage = 0 AND c.signal AND r.added < 2) AS fits
  FROM r JOIN c ON c.asked = r.asked AND c.n = r.n + 1 WHERE NOT r.ended))
SELECT asked, id, (1 + row_number() OVER (PARTITION BY asked ORDER BY n))::BIGINT AS citation, used FROM r WHERE id IS NOT NULL""")
def neighbour_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set, every document whose id is divisible by 50, with its neighbours of three kinds under 6000 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lower("text").alias("low"))
    asked = docs.filter("doc_id % 50 = 0")
    near = asked.select(F.col("doc_id").alias("asked"), F.explode(F.sequence(F.col("doc_id") - 20, F.col("doc_id") + 20)).alias("doc_id")).join(docs, "doc_id")
    gap = F.col("doc_id") - F.col("asked")
    kinds = F.array(F.when(F.contains("low", F.lit("the")), F.lit("coverage")), F.when(gap.between(1, 9), F.lit("table")), F.when(gap.between(-12, -1), F.lit("article")))
    found = near.select("asked", F.lit(1).alias("hit"), F.explode(F.array_compact(kinds)).alias("kind"), F.col("doc_id").alias("at"), F.col("doc_id").alias("id"), F.col("n_chars").alias("cost"), F.contains("low", F.lit("apache")).alias("signal"))
    hits = asked.select(F.col("doc_id").alias("asked"), F.col("doc_id").alias("id"), F.lit(1).alias("hit"), F.col("n_chars").alias("cost"))
    return expansion.expanded(hits, found, "asked", 6000)



@query("""WITH q AS (SELECT p_partkey AS asked, p_type, lower(p_name || ' of ' || p_brand) AS q, list_distinct(regexp_extract_all(lower(p_name || ' of ' || p_brand), '[a-z0-9]+')) AS a FROM part WHERE p_partkey % 50 = 0),
f AS (SELECT p_partkey, p_type, unnest(['brand', 'name', 'type']) AS field, unnest([2.0, 3.0, 1.0])::DOUBLE AS weight, unnest([lower(p_brand), lower(p_name), lower(p_type)]) AS value FROM part),
d AS (SELECT *, list_distinct(regexp_extract_all(value, '[a-z0-9]+')) AS v FROM f WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY p_partkey, value ORDER BY field) = 1),
p AS (SELECT asked, p_partkey, field, CASE WHEN n > 0 THEN weight * (n / len(v) * 0.45::DOUBLE + n / len(a) * 0.25::DOUBLE + n * 0.3::DOUBLE + CASE WHEN contains(q, value) THEN CASE WHEN len(v) >= 3 THEN 2.5 ELSE 0.5 END WHEN contains(value, q) THEN 0.25 ELSE 0 END::DOUBLE) ELSE 0 END AS part FROM (
  SELECT *, len(list_intersect(a, v)) AS n FROM q JOIN d USING (p_type))),
t AS (SELECT asked, p_partkey, sum(part) AS score, coalesce(string_agg(field, ',' ORDER BY field) FILTER (part > 0), '') AS matched FROM p GROUP BY asked, p_partkey)
SELECT asked, p_partkey, round(score, 6) AS score, matched, row_number() OVER (PARTITION BY asked ORDER BY round(score, 6) DESC, p_partkey)::INTEGER AS rank FROM (
  SELECT t.asked, t.p_partkey, matched, score + 0.2::DOUBLE * len(list_intersect(a, list_distinct(regexp_extract_all(lower(p_name || ' ' || part.p_type), '[a-z0-9]+')))) / len(a) AS score FROM t JOIN q ON q.asked = t.asked JOIN part ON part.p_partkey = t.p_partkey)
WHERE score >= 0.25 QUALIFY rank <= 20""")
def structured_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set, every part whose id is divisible by 50 as a question, against all rows of its type: the 20 best of those above the least score."""
    part = table(spark, sf_dir, "part")
    asked = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("asked"), "p_type", F.concat("p_name", F.lit(" of "), "p_brand").alias("question"))
    fields = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    rows = part.select("p_partkey", "p_type", fields.alias("fields"), F.concat_ws(" ", "p_name", "p_type").alias("raw"))
    found = evidence_rows.best_rows(rows, asked, "fields", F.col("raw"), F.col("question"), {"name": 3.0, "brand": 2.0, "size": 0.0}, "p_partkey", 20)
    return found.select("asked", "p_partkey", "score", F.array_join("matched", ",").alias("matched"), "rank")


@query("""SELECT user_id, event_type, max(row(ts, status))[2] AS state, epoch_us(min(ts) FILTER (status = 'running')) AS began_us,
  round((epoch_us(max(ts) FILTER (status <> 'running')) - epoch_us(min(ts) FILTER (status = 'running'))) / 1e6, 6) AS seconds
FROM (SELECT user_id, event_type, ts, CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'succeeded' ELSE 'running' END AS status FROM events) GROUP BY user_id, event_type""")
def job_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of jobs (users and event types) by a stateful stream over all events, dealt to files out of order and read in several triggers."""
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 7 < 3, "succeeded").otherwise("running")
    where = shared_dir(spark)
    logs = events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    logs.repartition(6, "ts").write.parquet(f"{where}/logs")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/logs")
    states = jobs.job_stream(stream, "user_id", "event_type", "ts", "status", late="36500 days")
    found = jobs.latest_states(states, ["user_id", "event_type"], where)
    return found.select("user_id", "event_type", "state", F.unix_micros("began").alias("began_us"), F.round("seconds", 6).alias("seconds"))


_KINDS = {"name": ("[A-Z][a-z]{4,}", 0.95), "number": ("[0-9]{4,}", 0.85)}


@query("""WITH m AS MATERIALIZED (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '[A-Z][a-z]{4,}'), lambda x: lower(x)), regexp_extract_all(text, '[0-9]{4,}'))[1:20] AS e FROM documents),
t AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(e) AS node FROM m),
g AS MATERIALIZED (SELECT DISTINCT e[1] AS node, e[2] AS other FROM m WHERE len(e) >= 2 UNION SELECT DISTINCT e[2], e[1] FROM m WHERE len(e) >= 2),
s AS (SELECT doc_id AS asked, node FROM t WHERE doc_id % 50 = 0 UNION SELECT asked, node FROM (SELECT DISTINCT doc_id AS asked FROM documents WHERE doc_id % 50 = 0), (SELECT DISTINCT node FROM t WHERE contains(node, 'licen'))),
n1 AS (SELECT * FROM s UNION SELECT asked, other FROM s JOIN g USING (node)),
n2 AS (SELECT * FROM n1 UNION SELECT asked, other FROM n1 JOIN g USING (node)),
c AS (SELECT asked, doc_id, count(DISTINCT node) AS score FROM n2 JOIN t USING (node) WHERE asked <> doc_id GROUP BY asked, doc_id)
SELECT asked, doc_id, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c QUALIFY rank <= 20""")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set, every document whose id is divisible by 50 with a term of its own, against the entities of all documents: the 20 best within two steps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mentions, nodes, edges = graph.graph_of(stored(graph.extracted(docs, "doc_id", "text", _KINDS)), "doc_id")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("asked"), "doc_id")
    return graph.best_chunks(mentions, nodes, edges, asked, asked.select("asked", F.lit("Licen").alias("term")), "asked", "doc_id", 2, 20)


@query("""WITH m AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[A-Z][a-z]{4,}'), regexp_extract_all(text, '[0-9]{4,}'))[1:20] AS e FROM documents)
SELECT lower(e[1]) AS a, lower(e[2]) AS b, 0.7::DOUBLE AS confidence, count(*) AS n_found FROM m WHERE len(e) >= 2 GROUP BY lower(e[1]), lower(e[2])""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations taken from all documents."""
    return graph.graph_of(graph.extracted(table(spark, sf_dir, "documents"), "doc_id", "text", _KINDS), "doc_id")[2]
