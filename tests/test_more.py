"""Operators of access, classification, evidence and chunking against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import question as Q
from lodestone.functions import sparse
from lodestone.functions import text as T
from lodestone.operators import access, boosts, chunking, filters, relational, retrieval


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame.select(column.alias("x")).first()["x"]


def test_deep_trees(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 80)] + [("n0", None), ("x", "x")], "code string, parent_code string")
    got = {r["code"]: r["depth"] for r in access.descendants(nodes, "n0").collect()}
    assert got == {f"n{i}": i for i in range(80)}


def test_splitter_takes_separators_that_begin_late():
    text = "a" * 849 + ". " + "b" * 600
    assert list(chunking.windows(text, 1000, 150))[0] == (0, 851)  # the full stop begins before 85 per cent, its blank at it
    text = "a" * 850 + ". " + "b" * 600
    assert list(chunking.windows(text, 1000, 150))[0] == (0, 852)
    assert list(chunking.windows(" \n\t", 1000, 150)) == [] and list(chunking.windows("", 10, 2)) == []


def test_uncovered_lines(spark):
    docs = spark.createDataFrame([(1, "first\n\n second\nthird"), (2, "alone"), (3, "")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, 9), (1, 7, 11), (1, 15, 20)], "doc_id long, start long, end long")
    assert {tuple(r) for r in chunking.missing_lines(docs, chunks).collect()} == {(1, 3, 1), (2, 1, 1), (3, 0, 0)}


def test_sparse_vectors(spark):
    texts = ["The API-1.2 of api_x", "Đà Nẵng 12/34 a/b", "", None, "x x x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: dict(zip(r["indices"], r["values"])) for r in sparse.vectors(docs).collect()}
    assert got == {i: pytest.approx(sparse.vector(t)) for i, t in enumerate(texts)}
    assert list(sparse.tokens("The API-1.2")) == ["the", "api-1.2", "api"]
    assert sparse.bucket("the") == 0x0 + int.from_bytes(__import__("hashlib").blake2b(b"the", digest_size=8).digest(), "big") % (1 << 20)
    weights = sparse.vector("x x x y")
    assert sorted(weights.values()) == pytest.approx(sorted(w / math.hypot(1, 1 + math.log(3)) for w in (1, 1 + math.log(3))))
    scored = sparse.vectors(docs).select("doc_id", sparse.dot(F.col("indices"), F.col("values"), sparse.vector("y zz")).alias("s")).collect()
    assert {r["doc_id"]: round(r["s"], 6) for r in scored if r["s"]} == {4: round(weights[sparse.bucket("y")] / math.sqrt(2), 6)}


def test_run_lengths(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (3, "c c")], "doc_id long, text string")
    assert sorted(map(tuple, retrieval.term_counts(docs).collect())) == [(1, "a", 1), (1, "b", 2), (3, "c", 2)]


def test_questions(spark):
    ask = lambda q: one(spark, Q.strategies(F.col("q")), q=q)
    assert ask("Tổng quan và danh sách các bảng") == ["overview_summary", "count_list", "table_detail", "calculation", "multi_hop"]
    assert ask("Hello") == ["semantic_search"] and ask("What is 12/AB?") == ["exact_lookup"]
    assert one(spark, Q.needs(Q.strategies(F.col("q"))), q="compare them").asDict() == {"overview": False, "diversity": True, "second": False}
    assert one(spark, Q.follows_up(F.col("q")), q="Còn văn bản này?") and not one(spark, Q.follows_up(F.col("q")), q="List all regions with large areas as tables")
    # Question words are listed with marks and compared without, so only those that have none are left out.
    assert Q.content_grams("phép năm của Bob") == ["phép năm của Bob", "phép năm của", "năm của Bob", "phép năm", "năm của", "của Bob"]
    assert Q.content_grams("theo Bob") == ["Bob"]
    assert Q.identifiers("see 3113/EVN-KD, 3113/evn-kd?") == ["3113/EVN-KD"] and Q.identifiers("a b") == []
    assert Q.embedding_text(" 3113 ").split("\n")[-1] == "3113" and Q.embedding_text("how  so") == "how so"


def test_text_functions(spark):
    assert one(spark, T.fold(F.col("t"), False), t="  Đường  ÉÀ ẵ é ") == "duong ea a e"
    assert one(spark, T.rewrite_text(F.col("t")), t="Đây là: A/1!") == "day la a 1"
    assert one(spark, T.clean_answer(F.col("t")), t="<think>a</think>ok\n\n\n\nSources:\n<think>open") == "ok"
    assert one(spark, T.clean_answer(F.col("t")), t="hidden</think> shown") == "shown"
    assert one(spark, T.unique_list(F.col("t")), t=" a, A;b. |  ,c  d") == ["a", "b", "c d"]
    assert one(spark, T.path_parts(F.col("t")), t="A > b>> C ") == ["A", "b", "C"]
    assert one(spark, T.json_object(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, T.json_object(F.col("t")), t="[1]") is None
    assert one(spark, T.days(F.col("t")), t="within 12 days") == 12 and one(spark, T.days(F.col("t")), t="none") is None
    assert one(spark, T.row_range(F.col("t")), t="| 3 | a\n|x|\n| 10 |").asDict() == {"first": 3, "last": 10}
    prompt = "Question: what\n is it?\n\nContext:\n[1] a\n[2] b\n[3] c\n[4] d"
    assert one(spark, T.fake_answer(F.col("t")), t=prompt).endswith("Question: what is it?. Relevant citations: [1] [2] [3]")


def test_boosts_without_a_query(spark):
    assert boosts.query_tokens("Có bao nhiêu bảng?") == ["bang"]
    assert one(spark, boosts.enrichment("là", F.col("t")), t="x") == 0.0
    assert one(spark, boosts.identifier("how many", F.col("t"), F.col("t"), F.col("t")), t="x") == 0.0


def test_metadata(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("text"), F.lit("body"))
    n = F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("2"))
    assert one(spark, filters.flat_metadata(m, n)) == {"a": "1", "b": "2"}
    assert one(spark, filters.merged_metadata(m, n)) == {"text": "body", "a": "0", "b": "2"}
    chunks = spark.createDataFrame([("c1", {"a": "1"}, None), ("c2", None, "old")], "chunk_id string, metadata map<string,string>, enriched_content string")
    results = spark.createDataFrame([("c1", {"b": "2"}, "new", "success"), ("c2", {"b": "3"}, "no", "failed")], "chunk_id string, metadata map<string,string>, enriched_content string, status string")
    assert {r["chunk_id"]: (r["metadata"], r["enriched_content"]) for r in filters.enrich(chunks, results).collect()} == {"c1": ({"a": "1", "b": "2"}, "new"), "c2": ({"b": "3"}, "old")}


def test_degrades_to_keywords(spark):
    keyword = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")

    def broken():
        raise RuntimeError("down")

    rows, degraded = retrieval.degraded(broken, keyword, "id")
    assert degraded and {r["flags"] for r in rows.collect()} == {"keyword"}
    rows, degraded = retrieval.degraded(lambda: keyword, keyword, "id")
    assert not degraded and {r["flags"] for r in rows.collect()} == {"vector+keyword"}


def test_graph_merge_and_jobs(spark):
    nodes, found = spark.createDataFrame([("a", 1)], "id string, v long"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "id string, v long")
    assert sorted(map(tuple, relational.merge_graph(nodes, found, "id").collect())) == [("a", 1), ("b", 3)]
    logs = spark.createDataFrame([("j", "parse", 10, "running"), ("j", "parse", 15, "succeeded"), ("j", "chunk", 16, "running")], "job string, step string, at long, status string")
    assert {r["step"]: (r["state"], r["seconds"]) for r in relational.job_states(logs, "job", "step", "at", "status").collect()} == {"parse": ("succeeded", 5.0), "chunk": ("running", None)}
