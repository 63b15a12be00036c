"""Token limits, table parts, tables in text, neighbours under a budget, row scores and the stream of jobs against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence_rows, expansion, index, limits, tables
from lodestone.sources import shared
from lodestone.streaming import jobs

TOKEN = re.compile(limits.TOKEN)


def tokens(text):
    return TOKEN.findall(text)


# Token limits


def plain_cuts(text, limit):
    """The rule read off word by word: look back from the full budget for a place to begin, as far as the part's first 55 per cent."""
    spans, out, start = [m.span() for m in TOKEN.finditer(text)], [], 0
    if len(spans) <= limit:
        return [len(spans)] if spans else []
    size = limits.budget(limit)
    while start < len(spans):
        full = end = min(start + size, len(spans))
        if full < len(spans):
            for i in range(full, min(full - 1, start + max(1, int(size * 0.55))), -1):
                before, gap = text[spans[i - 1][1] - 1], text[spans[i - 1][1] : spans[i][0]]
                if (before in ".!?;:" or "\n" in gap) and not text[spans[i][0]].islower():
                    end = i
                    break
        out.append(end)
        start = end
    return out


def test_hard_parts():
    rng = random.Random(4)
    for limit in (8, 33, 40, 64, 100):
        for _ in range(40):
            text = " ".join(rng.choice(["word", "Word", "end.", "Two;", "x,", "line\n", "\n\nNew", "ünï", "?!"]) for _ in range(rng.randint(0, 400)))
            parts = limits.hard_parts(text, limit)
            ends = [sum(n for _, _, n in parts[: i + 1]) for i in range(len(parts))]
            assert ends == plain_cuts(text, limit)
            assert all(n <= limit for _, _, n in parts) and [t for a, b, _ in parts for t in tokens(text[a:b])] == tokens(text)
    assert limits.hard_parts("word " * 100_000, 350)[-1][2] > 0


def test_limited(spark):
    heads = "# Title\n# Part\n"
    texts = [(1, None), (2, ""), (3, "short text"), (4, heads + "\n".join(f"line {i} of the part." for i in range(40))), (5, "word " * 500), (6, heads + "one " * 200 + "\nshort"), (None, "a. " * 300), (None, "# " * 60), (8, "# only\n# heads\n" * 40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(3)
    rows = limits.limited(docs, 60).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        assert r["n_tokens"] == len(tokens(r["text"])) <= 60
        by.setdefault((r["doc_id"], r["how"]), []).append(r["text"])
    assert by[1, "whole"] == by[2, "whole"] == [""] and by[3, "whole"] == ["short text"]
    assert all(p.startswith(heads) for p in by[4, "blocks"]) and heads + "\n".join(p[len(heads) :] for p in by[4, "blocks"]) == texts[3][1]
    assert [t for p in by[5, "hard"] for t in tokens(p)] == tokens(texts[4][1])
    assert [t for p in by[6, "hard"] for t in tokens(p)] == tokens(texts[5][1])
    assert limits.limited(docs.limit(0), 60).count() == 0 and limits.cut(docs, 60).filter("doc_id IN (1, 2)").count() == 0


def test_balanced_tables():
    rng = random.Random(7)
    for _ in range(3000):
        costs, limit, fixed = [rng.randint(1, 60) for _ in range(rng.randint(0, 30))], rng.randint(40, 160), rng.randint(0, 20)
        greedy, even = limits.packed(costs, limit, fixed), limits.balanced(costs, limit, fixed)
        assert even == sorted(even) and len(even) == len(costs)
        if not costs or greedy[-1] == 0:
            assert even == greedy
            continue
        last = greedy[-1]
        assert [p for p in even if p < last - 1] == [p for p in greedy if p < last - 1]
        sums = {p: fixed + sum(c for c, q in zip(costs, even, strict=True) if q == p) for p in set(even)}
        single = {p for p in sums if even.count(p) == 1}
        moved = greedy.count(last) == 1 and even.count(last) == 2  # a tail of one row may take one more in spite of the limit
        assert all(n <= limit or p in single or moved and p == last for p, n in sums.items())
        if even.count(last - 1) > 2 and even.count(last) >= 1:  # the tail is long enough, or no row could go
            head = [c for c, q in zip(costs, even, strict=True) if q == last - 1]
            assert even.count(last) >= 2 and sums[last] >= max(72, int(limit * 0.3)) or sums[last] + head[-1] > limit or sums[last - 1] - head[-1] > limit or even.count(last) < 2
    assert limits.balanced([50] * 5, 110, 5) == [0, 0, 1, 1, 2] and limits.balanced([20] * 13, 100) == [0] * 5 + [1] * 4 + [2] * 4


# Tables in text

STAFF = "Staff list\nName        Area          Phone\nAnn Bell    Networks      12\n            and radio\n\nBob         Storage       7\nEnd of it.\nA | B\n---|---\n1 | 2\ntail"


def test_regions():
    found = tables.regions_of(STAFF)
    assert [(k, rows) for k, _, _, rows in found] == [("aligned", [["Name", "Area", "Phone"], ["Ann Bell", "Networks and radio", "12"], ["Bob", "Storage", "7"]]), ("pipe", [["A", "B"], ["1", "2"]])]
    assert [STAFF[a:b].split("\n")[0] for _, a, b, _ in found] == ["Name        Area          Phone", "A | B"]
    assert tables.regions_of("one  two") == [] and tables.regions_of("") == [] and tables.regions_of("a | b\n---|---") == []
    assert len(tables.regions_of("a  b\nc  d\n\n\ne  f\ng  h")) == 2 and len(tables.regions_of("a  b\nc  d\n\ne  f\ng  h")) == 1
    assert tables.column_starts([[(0, "a"), (10, "b")], [(2, "c"), (11, "d")], [(1, "e"), (30, "f")]]) == [1, 10]


def test_prose_and_tables_cover_the_text(spark):
    rng = random.Random(9)
    pieces = ["plain words\n", "a | b\n", "x   y\n", "    more\n", "\n", "--|--\n", "é   ü | 漢\n", "end"]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(None, STAFF), (100, None), (101, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    by = {}
    for r in tables.prose_and_tables(docs).collect():
        by.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["kind"], r["part"]))
    for k, text in texts:
        parts = sorted(by.get(k, []))
        assert "".join(p for _, _, _, p in parts) == (text or "") and all(text[a:b] == p for a, b, _, p in parts)
        assert [a for a, _, _, _ in parts[1:]] == [b for _, b, _, _ in parts[:-1]]
        assert [(kind, a, b) for a, b, kind, _ in parts if kind != "prose"] == [r[:3] for r in tables.regions_of(text or "")]


def test_uncovered(spark):
    lengths = spark.createDataFrame([(1, 10), (2, 5), (3, 0), (None, 4)], "k int, n int")
    ranges = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 5, 5), (1, 8, 20), (2, 0, 5), (None, 1, 2)], "k int, start int, end int")
    got = sorted(map(tuple, tables.uncovered(lengths, ranges, "k").collect()), key=repr)
    assert got == sorted([(1, 0, 2), (1, 6, 8), (None, 0, 1), (None, 2, 4)], key=repr)


def test_rewritten(spark):
    got = {r["doc_id"]: r["text"] for r in tables.rewritten(spark.createDataFrame([(1, STAFF), (2, " only prose \n"), (3, None)], "doc_id int, text string")).collect()}
    assert got[1].startswith("Staff list\n\nTABLE_ROW table_id=t1 row=1 | Name: Ann Bell | Area: Networks and radio | Phone: 12\nTABLE_ROW") and got[1].endswith("\n\ntail") and "End of it." in got[1]
    assert got[2] == "only prose" and got[3] == ""


# Neighbours


def test_expanded(spark):
    """What does not fit is passed over among coverage, ends the rest; strong ones may go beyond twice a hit; ids come in once."""
    hits = spark.createDataFrame([("q", 1, 1, 50), ("q", 2, 2, 20), (None, 9, 1, 10), ("none", 5, 1, 1)], "asked string, id int, hit int, cost int")
    near = [
        ("q", 1, "coverage", 1, 10, 40, False), ("q", 1, "coverage", 2, 11, 20, False), ("q", 1, "coverage", 3, 12, 90, True), ("q", 1, "coverage", 4, 13, 90, True), ("q", 1, "coverage", 5, 2, 1, False),
        ("q", 2, "coverage", 1, 12, 1, True), ("q", 2, "coverage", 2, 14, 5, True), ("q", 2, "table", 1, 15, 500, False), ("q", 2, "article", 1, 16, 1, False), (None, 1, "article", 1, 3, None, None), (None, 1, "table", 1, 4, 30, None),
    ]
    rows = spark.createDataFrame(near, "asked string, hit int, kind string, at int, id int, cost int, signal boolean")
    got = expansion.expanded(hits, rows, "asked", 100).collect()
    assert sorted((r["citation"], r["id"], r["used"]) for r in got if r["asked"] == "q") == [(3, 11, 90), (4, 12, 180), (5, 14, 185)]
    assert sorted((r["citation"], r["id"], r["used"]) for r in got if r["asked"] is None) == [(2, 4, 40), (3, 3, 40)] and len(got) == 5


# Structured rows


def test_row_scores(spark):
    rows = spark.createDataFrame([(1, {"owner": "Ánn Bell", "task": "Build the core network", "note": None}, "Ann Bell core"), (2, {"owner": "Bob", "task": "bob"}, ""), (3, {}, None)], "id int, fields map<string,string>, raw string")
    asked = spark.createDataFrame([("Who is Ann Bell?", 1), ("", 1), ("build the core NETWORK now", 1)], "question string, kb int")
    with pytest.raises(ValueError):
        evidence_rows.row_scores(rows, asked, "fields", F.col("raw"), F.col("question"), {})
    rows = rows.withColumn("kb", F.lit(1))
    got = {(r["id"], r["question"]): r for r in evidence_rows.row_scores(rows, asked, "fields", F.col("raw"), F.col("question"), {"owner": 2.0, "note": 0.0}).collect()}
    first = got[1, "Who is Ann Bell?"]
    assert first["matched"] == ["owner"] and abs(first["score"] - (2 * (0.45 + 0.25 * 2 / 4 + 0.6 + 0.5) + 0.2 * 2 / 4)) < 1e-9
    last = got[1, "build the core NETWORK now"]
    assert last["matched"] == ["task"] and abs(last["score"] - (0.45 + 0.25 * 4 / 5 + 1.2 + 2.5 + 0.2 * 1 / 5)) < 1e-9
    assert all(got[i, ""]["score"] == 0 and got[i, ""]["matched"] == [] for i in (1, 2, 3)) and got[3, "Who is Ann Bell?"]["score"] == 0
    assert evidence_rows.evidence(evidence_rows.row_scores(rows, asked, "fields", F.col("raw"), F.col("question"), {})).count() == 2


@pytest.mark.parametrize("block", [1024, 3])
def test_best_rows(spark, monkeypatch, block):
    """The first rows of ``row_scores``, whatever the blocks, with rows of one content, ties, nulls and repeated questions."""
    monkeypatch.setattr(evidence_rows, "BLOCK", block)
    rng = random.Random(5)
    words = ["core", "Ánn", "bell", "net", "net core", "build the net", "", None]
    rows = [(i if i else None, rng.choice(["a", "b", None]), {"owner": rng.choice(words), "task": rng.choice(words), "note": rng.choice(words)}, rng.choice(words)) for i in range(300)]
    asked = [(i, rng.choice(["a", "b", None]), " ".join(rng.choice(words) or "?" for _ in range(rng.randint(1, 5)))) for i in range(40)] + [(40, "a", "Core"), (41, "a", "core"), (42, "a", None), (43, "b", "")]
    rows = spark.createDataFrame(rows, "id int, kb string, fields map<string,string>, raw string").repartition(3)
    asked = spark.createDataFrame(asked, "n int, kb string, question string")
    more = {"owner": 2.0, "note": 0.0}
    scored = evidence_rows.evidence(evidence_rows.row_scores(rows, asked, "fields", F.col("raw"), F.col("question"), more)).withColumn("score", F.round("score", 6))
    shown = ["n", "kb", "question", "id", "score", "matched", "rank"]
    wanted = index.best(scored, "n", 7, F.desc("score"), F.col("id")).select(*shown).collect()
    got = evidence_rows.best_rows(rows, asked, "fields", F.col("raw"), F.col("question"), more, "id", 7)
    assert got.columns == shown and Counter(map(repr, got.collect())) == Counter(map(repr, wanted)) and len(wanted) > 100


def test_best_rows_of_repeated_rows(spark, monkeypatch):
    """Rows that say the same are compared once: the texts that meet do not grow with their number."""
    seen = []
    monkeypatch.setattr(evidence_rows, "map_batches", lambda rows, run, schema: seen.append(rows.select(F.size("held").alias("n")).agg(F.sum("n")).first()[0]) or shared.map_batches(rows, run, schema))
    asked = spark.createDataFrame([("core net", 1)], "question string, kb int")
    for n in (20, 20000):
        rows = spark.range(n).select("id", F.lit(1).alias("kb"), F.create_map(F.lit("owner"), F.concat(F.lit("core "), (F.col("id") % 5).cast("string"))).alias("fields"), F.lit("net").alias("raw"))
        got = evidence_rows.best_rows(rows, asked, "fields", F.col("raw"), F.col("question"), {}, "id", 6)
        assert [r["id"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == [0, 1, 2, 3, 4, 5]
    assert seen == [5, 5]


# Jobs

LOGS = "job string, step string, at timestamp, status string"


def log_rows(spark, n=300):
    rng = random.Random(2)
    rows = [(f"j{rng.randint(0, 5)}", rng.choice(["parse", "chunk", None]), 1_700_000_000 + rng.randint(0, 5000), rng.choice(["running", "running", "succeeded", "failed"])) for _ in range(n)] + [("j0", "parse", None, "running"), ("j0", "parse", 1_700_000_000, None)]
    return spark.createDataFrame(rows, "job string, step string, s long, status string").select("job", "step", F.timestamp_seconds("s").alias("at"), "status")


def test_job_stream_goes_on_after_a_restart(spark, tmp_path):
    """Rows out of order over several triggers, then more of them in a second run from the same checkpoint: the states are those of a batch."""
    logs = log_rows(spark)
    one, two = logs.randomSplit([0.5, 0.5], seed=3)
    one.repartition(3).write.parquet(f"{tmp_path}/logs")

    def run():
        stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/logs")
        return jobs.latest_states(jobs.job_stream(stream, "job", "step", "at", "status", late="1000 days"), ["job", "step"], str(tmp_path))

    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(run().collect()) == key(jobs.batch_states(spark.read.parquet(f"{tmp_path}/logs"), "job", "step", "at", "status").collect())
    two.repartition(2).write.mode("append").parquet(f"{tmp_path}/logs")
    got = run()
    assert key(got.collect()) == key(jobs.batch_states(logs, "job", "step", "at", "status").collect())
    triggers = spark.read.parquet(f"{tmp_path}/states").select("trigger").distinct().count()
    assert triggers >= 5


def test_job_stream_runs_no_python_for_each_step(spark, tmp_path, monkeypatch):
    """Without a limit of silence, no step costs a call of its own: with tens of thousands of steps those calls were most of the time."""
    logs = spark.range(60000).select((F.col("id") % 20000).alias("job"), F.lit("s").alias("step"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("at"), F.when(F.col("id") < 40000, "running").otherwise("failed").alias("status"))
    logs.repartition(4).write.parquet(f"{tmp_path}/logs")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/logs")
    states = jobs.job_stream(stream, "job", "step", "at", "status", late="1000 days")
    assert "PythonWithState" not in states._jdf.queryExecution().analyzed().toString() and "PandasWithState" not in states._jdf.queryExecution().analyzed().toString()
    got = jobs.latest_states(states, ["job", "step"], str(tmp_path))
    assert got.count() == 20000 and got.filter("state = 'failed' AND seconds = 40000").count() == 20000


def test_idle_jobs_stall(spark, tmp_path):
    rows = [("a", "s", 0, "running"), ("b", "s", 0, "running"), ("b", "s", 10, "succeeded")]
    later = [("c", "s", 100_000, "running")]
    for i, part in enumerate((rows, later, [("c", "s", 100_001, "running")])):
        spark.createDataFrame(part, "job string, step string, s long, status string").select("job", "step", F.timestamp_seconds(F.col("s") + 1_000_000).alias("at"), "status").coalesce(1).write.mode("append").parquet(f"{tmp_path}/logs{i}")
    seen = {}
    for i in range(3):  # one more folder for every run
        spark.read.parquet(f"{tmp_path}/logs{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/logs")
        stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/logs")
        states = jobs.job_stream(stream, "job", "step", "at", "status", late="10 seconds", idle="1 hour")
        seen = {r["job"]: (r["state"], r["seconds"]) for r in jobs.latest_states(states, ["job", "step"], str(tmp_path)).collect()}
    assert seen == {"a": ("stalled", None), "b": ("succeeded", 10.0), "c": ("running", None)}


@pytest.mark.parametrize("costs", [[], [500], [1] * 50, [100, 1, 100]])
def test_packed(costs):
    parts = limits.packed(costs, 100, 10)
    assert len(parts) == len(costs) and parts == sorted(parts) and (not parts or parts[0] == 0)
    for p in set(parts):
        mine = [c for c, q in zip(costs, parts, strict=True) if q == p]
        assert len(mine) == 1 or sum(mine) + 10 <= 100
