"""Passes over ordered records against plain loops, on short, long and awkward documents."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import records


def loop(steps):
    """(before, after) of every (op, value)."""
    state, out = None, []
    for op, value in steps:
        before = state
        state = value if op == "put" or op == "fill" and state is None else None if op == "clear" else state
        out.append((before, state))
    return out


def step():
    is_ = lambda x: F.col("op") == x
    return {"s": records.Step(F.col("value"), is_("put"), is_("clear"), is_("fill"))}


@pytest.mark.parametrize("segment", [1, 3, 7, 4096])
def test_carried_equals_a_loop(spark, segment):
    rng = random.Random(segment)
    docs = {k: [(rng.choice(["put", "clear", "fill", "fill", "keep", "keep", "keep", None]), rng.choice("abc")) for _ in range(rng.randint(0, 60))] for k in (1, 2, 3, None)}
    rows = spark.createDataFrame([(k, i, *x) for k, v in docs.items() for i, x in enumerate(v)], "doc long, at long, op string, value string").repartition(5)
    got = records.carried(rows, ["doc"], "at", step(), segment).collect()
    assert len(got) == sum(map(len, docs.values()))
    for k, v in docs.items():
        mine = sorted((r for r in got if r["doc"] == k), key=lambda r: r["at"])
        assert [(r["s_before"], r["s_after"]) for r in mine] == loop(v)
    assert records.carried(rows.limit(0), ["doc"], "at", step()).count() == 0


def test_one_long_document_is_dealt_to_several_tasks(spark):
    """10**6 records of one document: states reach over segments, and no task has them all."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("at"), F.when(F.col("id") % 300_000 == 5, "put").when(F.col("id") % 450_000 == 70, "clear").when(F.col("id") % 10_007 == 9, "fill").alias("op"), F.col("id").cast("string").alias("value"))
    found = records.carried(rows, ["doc"], "at", step()).withColumn("task", F.spark_partition_id()).cache()
    marks = {i: "put" if i % 300_000 == 5 else "clear" if i % 450_000 == 70 else "fill" for i in range(n) if i % 300_000 == 5 or i % 450_000 == 70 or i % 10_007 == 9}
    want = dict(zip(marks, (after for _, after in loop([(op, str(i)) for i, op in marks.items()])), strict=True))
    assert {r["at"]: r["s_after"] for r in found.filter(F.col("op").isNotNull()).collect()} == want
    kept = found.groupBy("task").count().collect()
    assert len(kept) > 1 and max(r["count"] for r in kept) < 0.6 * n
    # A record between two marks has the state of the earlier one.
    marked = sorted(want)
    for r in found.filter("at % 99991 = 3 AND op IS NULL").collect():
        assert r["s_before"] == r["s_after"] == next((want[m] for m in reversed(marked) if m < r["at"]), None)
    found.unpersist()


def test_stale_headings(spark):
    """Rows that go on take the open table's heading; a table's own name and a section reset it."""
    rows = [
        (0, "F05. Poles", None, True, None, False), (1, "F09. Lines", 4, True, None, False), (2, None, 9, False, None, False), (3, "F09. Lines", 1, True, None, False),
        (4, "f09. LINES", 7, True, None, False), (5, "F05. Poles", 2, True, "PhotoTable", False), (6, None, 3, False, None, False), (7, "Appendix", None, False, None, True), (8, None, 2, False, None, False), (9, "F07. Roads", 5, True, None, False), (10, None, None, False, None, False),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc int, at int, h string, n int, object boolean, named string, ends boolean")
    got = records.repaired_headings(df, ["doc"], "at", F.col("h"), F.col("n"), F.col("object"), F.col("named"), F.col("ends")).orderBy("at").collect()
    assert [(r["heading"], r["repair"]) for r in got] == [
        ("F05. Poles", None), ("F05. Poles", "replaced"), ("F05. Poles", "prefixed"), ("F09. Lines", None), ("f09. LINES", None), ("PhotoTable", "replaced"), ("PhotoTable", "prefixed"), ("Appendix", None), (None, None), ("F07. Roads", None), (None, None),
    ]
    assert [r["current"] for r in got][6:] == ["PhotoTable", None, None, "F07. Roads", "F07. Roads"]


def test_leads_go_forward(spark):
    """Every second one of a row of leads is taken on; a page gap and the end of a document keep a lead; a repeated heading goes."""
    rows = [(0, "Part A", True, 1), (1, "Part A\nbody", False, 1), (2, "one", True, 1), (3, "two", True, 2), (4, "three", True, 2), (5, "text", False, 2), (6, "far", True, 2), (7, "page five", False, 5), (8, "last", True, 5)]
    df = spark.createDataFrame([(None, *r) for r in rows], "doc int, at long, text string, is_lead boolean, page int")
    got = records.leads_forward(df, ["doc"], "at", "text", F.col("is_lead"), F.col("page"), F.split("text", "\n")[0], F.lit(False), segment=2).orderBy("at").collect()
    assert [(r["at"], r["text"], r["merged_from"]) for r in got] == [(1, "Part A\nbody", 0), (3, "one\ntwo", 2), (5, "three\ntext", 4), (6, "far", None), (7, "page five", None), (8, "last", None)]


def test_section_paths(spark):
    heads = [(0, 1, "A"), (1, None, None), (2, 3, "A.x"), (3, 2, "B"), (4, 3, "B.y"), (5, None, None), (6, 1, "C"), (7, None, None), (8, 3, "C.z")]
    df = spark.createDataFrame([(1, *h) for h in heads], "doc int, at long, level int, title string")
    got = records.section_paths(df, ["doc"], "at", F.col("level"), F.col("title"), segment=4).orderBy("at").collect()
    assert [(r["path"], r["parent"]) for r in got] == [(["A"], None), (["A"], "A"), (["A", "A.x"], "A"), (["A", "B"], "A"), (["A", "B", "B.y"], "B"), (["A", "B", "B.y"], "B.y"), (["C"], None), (["C"], "C"), (["C", "C.z"], "C")]
