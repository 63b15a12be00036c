"""Tables in text, layout passes, rule enrichment and contracts against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import enrich
from lodestone.functions import question as Q
from lodestone.operators import layout, retrieval, tables
from lodestone.plans import queries as plans


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))
    return frame.select(column.alias("x")).first()["x"]


def test_tables_and_headers(spark):
    text = "before\n| Name | Age |\n|---|:-:|\n| Ann | 7 |\n|  Bo  b | |\nafter | alone\n\n1 | 2\n3 | 4 | 5"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a | b")], "doc_id long, text string")
    got = {r["first_line"]: r for r in tables.with_headers(tables.blocks(docs)).collect()}
    assert sorted(got) == [1, 7]
    assert got[1]["headed"] and got[1]["headers"] == ["Name", "Age"] and got[1]["rows"] == [["Ann", "7"], ["Bo b", ""], ["after", "alone"]]
    assert not got[7]["headed"] and got[7]["headers"] == ["cell_1", "cell_2", "cell_3"] and got[7]["rows"] == [["1", "2", ""], ["3", "4", "5"]]
    t = tables.with_headers(tables.blocks(docs)).filter("first_line = 1")
    assert [r["content"] for r in tables.row_records(t, F.lit("T1"), "doc_id").collect()][0] == "TABLE_ROW table_id=T1 row=1 | Name: Ann | Age: 7"
    assert [tuple(r) for r in tables.parts(t, 8, "doc_id").collect()] == [(1, 1, 1, 1, 6), (1, 2, 2, 2, 6), (1, 3, 3, 3, 6)]  # a header of 3 tokens, rows of 3
    assert [tuple(r) for r in tables.parts(t, 9, "doc_id").collect()] == [(1, 1, 1, 2, 9), (1, 2, 3, 3, 6)]


def test_articles(spark):
    text = "CHƯƠNG I. Chung\nĐiều 1. Phạm vi\na\nCHƯƠNG II\nx\nĐiều 2: Hai\nb\nc\n**Điều 3 Ba**"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "")], "doc_id long, text string")
    got = [tuple(r) for r in layout.articles(docs).collect()]
    assert got == [(1, 1, "1", "Phạm vi", "I", 1, 3, "Điều 1. Phạm vi\na"), (1, 2, "2", "Hai", "II", 5, 8, "Điều 2: Hai\nb\nc"), (1, 3, "3", "Ba", "II", 8, 9, "**Điều 3 Ba**")]
    assert [r["x"] for r in docs.orderBy("doc_id").select(layout.is_legal(F.col("text"), least=3).alias("x")).collect()] == [True, False, False, False]


def recent(text, reach=12):
    out, kept, blank = [], [], True
    for x in (" ".join(line.split()) for line in text.split("\n")):
        if x == "":
            out += [] if blank else [""]
            blank = True
        elif x.lower() not in kept[-reach:]:
            out.append(x)
            kept.append(x.lower())
            blank = False
    return "\n".join(out).rstrip("\n")


@pytest.mark.parametrize("reach", [1, 2, 12])
def test_recent_lines(spark, data, reach):
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + ["", "a\nA\nb\na\n\n\n \nb", "x\ny\nx\nx"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["x"] for r in frame.select("i", layout.without_recent(F.col("text"), reach).alias("x")).collect()}
    bad = [i for i, t in enumerate(texts) if t is not None and t.isascii() and got[i] != recent(t, reach)]
    assert bad == []


def test_enrichment(spark):
    text = "Công văn số 3113 ngày 12/05/2020, mã 45 / AB-1, 45/ab-1 và 99999"
    assert one(spark, enrich.document_codes(F.col("t")), t=text) == ["45/AB-1"]
    assert one(spark, enrich.dates(F.col("t")), t=text + " 1/1/20200") == ["12/05/2020"]
    assert one(spark, enrich.contextual_numbers(F.col("t")), t=text) == ["3113"]
    assert one(spark, enrich.contextual_numbers(F.col("t")), t="x" * 50 + " 777 " + "y" * 90 + " số") == []
    assert one(spark, enrich.deadlines(F.col("t")), t="Tháng  03/2024, quý 1/2024, tháng 03/2024") == ["Tháng 03/2024", "quý 1/2024"]
    quality = lambda t: one(spark, enrich.text_quality(F.col("t")), t=t)
    assert (quality(None), quality(" \n"), quality("((("), quality("one two a"), quality("xGIS ok <!-- q")) == (-100.0, -100.0, -50.0, 0.0, 4 - 3 - 8 - 3.0)
    none = F.lit(None).cast("long")
    e = one(spark, enrich.by_rules(F.col("t"), F.lit("T"), F.lit(2).cast("long"), none), t="7/ABC 1/2/2020 7/abc 123")
    assert (e["document_code"], e["issued_date"], e["row_range"]) == (None, "1/2/2020", "2-2") and e["identifiers"] == ["1/2/2020", "2020", "123"]
    assert one(spark, enrich.labelled({"summary": F.lit(" ")})) is None
    plan = lambda t, mode="selective": tuple(one(spark, enrich.needs_model(F.col("t"), F.lit("text"), enrich.by_rules(F.col("t"), F.lit(""), none, none), F.lit(None).cast("boolean"), F.lit(None), F.lit(None).cast("boolean"), F.lit(False), F.lit(0), F.lit(None).cast("double"), F.lit(""), mode), t=t))
    assert [plan(None), plan("12345"), plan("word"), plan("word", "all"), plan("word", "off")] == [(False, "empty_content"), (True, "short_with_codes"), (False, "selective_no_trigger"), (True, "mode_all"), (False, "mode_off")]


def test_contracts(spark):
    ask = lambda q: one(spark, Q.contract(F.col("q")), q=q)
    assert ask("Find 3113/QD-X.")["intent"] == "identifier_lookup" and ask("Find 3113/QD-X.")["exact_terms"] == ["3113/QD-X"]
    assert (ask("Who owns this area?")["intent"], ask("Who owns this area?")["shape"]) == ("person_assignment", "table")
    assert ask("Thủ tục xin nghỉ")["intent"] == "procedure_lookup" and ask("Mức hưởng và số ngày nghỉ")["intent"] == "policy_rule_lookup"
    assert (ask(None)["intent"], ask("")["shape"], ask("summarize it")["shape"]) == ("general_summary", "short_fact", "report")


def test_small_rules(spark):
    assert [one(spark, layout.file_kind(F.col("n"), F.col("m")), n=n, m=m) for n, m in (("A.XLSX", None), (None, "application/vnd.ms-powerpoint"), ("x.txt", "text/plain"))] == ["spreadsheet", "slide", None]
    assert [one(spark, layout.quality_status(F.array(*map(F.lit, i)).cast("array<string>"))) for i in ([], ["warning"], ["warning", "critical"])] == ["pass", "warning", "fail"]
    rows = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True), (1, 3, "c", False), (1, 4, "d", None)], "k int, n int, g string, planned boolean")
    assert {r["n"]: r["calls"] for r in layout.first_planned(rows, "k", "n", F.col("planned"), 1).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_empty_tables(spark, data):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tables.with_headers(tables.blocks(empty)).isEmpty() and layout.articles(empty).isEmpty() and layout.conflicts(empty).isEmpty()
    assert plans.queries()["recent_line_dedupe"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_query_set(spark):
    points = spark.createDataFrame([(i, [float(i % 7), 1.0, 0.0]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0])], "k long, v array<float>")
    unit = {i: [x / ((i % 7) ** 2 + 1) ** 0.5 for x in (i % 7, 1)] for i in range(40)}
    want = {(q, k, r) for q in (0, 10, 33) for r, k in enumerate(sorted(unit, key=lambda k: (-round(sum(a * b for a, b in zip(unit[q], unit[k], strict=True)), 6), k))[:5], 1)}
    for block in (4, 1024):
        got = retrieval.top_of_set(points, points.filter("k IN (0, 10, 33, 40, 41)"), 5, "k", "v", block)
        assert {(r["query"], r["k"], r["rank"]) for r in got.collect()} == want
    assert retrieval.top_of_set(points.limit(0), points, 5, "k", "v").isEmpty()
