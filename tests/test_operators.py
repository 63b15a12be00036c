"""Operators of retrieval, access, context, chunking, sources and streaming."""

import datetime
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import access, artifacts, chunking, context, conversation, graph, relational, retrieval, structure
from lodestone.sources import files
from lodestone.streaming import monitor


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_fusion_ranks_the_overlap_first(spark):
    left = frame(spark, [("a", 1), ("b", 2)], "id string, rank long")
    right = frame(spark, [("b", 1), ("c", 2)], "id string, rank long")
    got = {r["id"]: (round(r["fused"], 9), r["flags"]) for r in retrieval.fuse(left, right, "id").collect()}
    assert got == {"b": (round(1 / 62 + 1 / 61, 9), "vector+keyword"), "a": (round(1 / 61, 9), "vector"), "c": (round(1 / 62, 9), "keyword")}


def test_scope_none_and_empty(spark):
    rows = frame(spark, [(1,), (2,)], "id long")
    assert retrieval.within(rows, None, "id").count() == 2
    assert retrieval.within(rows, rows.limit(0), "id").count() == 0
    assert retrieval.excluding(rows, rows.filter("id = 1"), "id").first()["id"] == 2


def test_cosine_and_filter(spark):
    points = frame(spark, [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 1), (3, [0.0, 2.0], 1)], "id long, embedding array<float>, label int")
    got = retrieval.top(retrieval.vector_scores(points, [0.0, 1.0], keep=F.col("label") == 1), 2, F.desc("score")).collect()
    assert [r["id"] for r in got] == [3, 2] and abs(got[1]["score"] - 0.8) < 1e-6


@pytest.mark.parametrize(
    "row, reason",
    [
        ({"classification": 0, "visibility": "public"}, "public"),
        ({"classification": 3}, "clearance"),
        ({"denied_users": ["u"], "allowed_users": ["u"], "visibility": "public"}, "denied_user"),
        ({"denied_roles": ["r"], "visibility": "public"}, "denied_role"),
        ({"allowed_roles": ["r"]}, "allowed_role"),
        ({"owner": "u"}, "owner"),
        ({"visibility": "organization", "organization": "o"}, "organization"),
        ({"visibility": "subtree", "org_path": "/o"}, "subtree"),
        ({"visibility": "private"}, "no_rule"),
    ],
)
def test_access_cascade(spark, row, reason):
    schema = "classification int, visibility string, organization string, org_path string, owner string, denied_users array<string>, denied_roles array<string>, allowed_users array<string>, allowed_roles array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = frame(spark, [tuple(row.get(n) for n in names)], schema)
    subject = access.Subject(user="u", organization="o", path="/o/x", roles=("r",), clearance=2)
    got = rows.select(access.decision(subject).alias("d")).first()["d"]
    assert got["reason"] == reason and got["allowed"] == (reason in ("public", "allowed_role", "owner", "organization", "subtree"))
    off = rows.select(access.decision(access.Subject(user="u", active=False)).alias("d")).first()["d"]
    assert off["reason"] == "inactive"


def test_descendants_with_a_cycle(spark):
    nodes = frame(spark, [("a", None), ("b", "a"), ("c", "b"), ("b", "c"), ("x", None)], "code string, parent_code string")
    assert {(r["code"], r["depth"]) for r in access.descendants(nodes, "a").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_windows_of_the_splitter():
    text = "abcdefghijklmnopq"
    assert [(text[a:b], a) for a, b in chunking.windows(text, 10, 3)] == [("abcdefghij", 0), ("hijklmnopq", 7)]
    first = "a" * 900 + "\n\n" + "b" * 600
    assert next(chunking.windows(first, 1000, 150)) == (0, 902) and list(chunking.windows(first, 1000, 150))[1][0] == 752
    early = "a" * 560 + "\n\n" + "b" * 700
    assert list(chunking.windows(early, 1000, 150))[:2] == [(0, 1000), (850, len(early))]
    assert list(chunking.windows("", 10, 3)) == []


def test_split_covers_every_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chunks = {}
    for r in chunking.split(docs).collect():
        chunks.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        mine = sorted(chunks.get(d["doc_id"], []), key=lambda r: r["chunk_index"])
        assert all(r["chunk"] == d["text"][r["start"] : r["end"]] and r["end"] - r["start"] <= 1000 for r in mine)
        assert (mine[0]["start"], mine[-1]["end"]) == (0, len(d["text"])) and all(b["start"] <= a["end"] for a, b in zip(mine, mine[1:]))


def test_merge_and_sections(spark):
    rows = frame(spark, [(1, "Title\nThis goes\non here.\n\nnext Line\nand more"), (2, None)], "doc_id long, text string")
    merged = context.merge_broken_lines(context.lines(rows, "doc_id", "text"), "doc_id").orderBy("first_line").collect()
    assert [r["merged"] for r in merged] == ["Title", "This goes on here.", "next Line and more"]
    parts = context.sections(context.lines(rows, "doc_id", "text"), "doc_id", F.length("line") == 5).collect()
    assert {r["heading"] for r in parts} == {"Title"}


def test_dedupe_and_budget(spark):
    rows = frame(spark, [(1, "A  b"), (2, "a b "), (3, "c")], "id long, text string")
    assert {(r["id"], r["copies"]) for r in context.dedupe(rows, "id", "text").collect()} == {(1, 2), (3, 1)}
    sized = rows.withColumn("g", F.lit(0)).withColumn("n", F.lit(4))
    assert [r["id"] for r in context.within_budget(sized, "g", "n", 8, F.col("id")).collect()] == [1, 2]


def test_sinks_and_merges(spark):
    old = frame(spark, [(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    new = frame(spark, [(1, "z")], "k long, v string")
    assert {tuple(r) for r in relational.replace_rows(old, new, "k").collect()} == {(1, "z"), (2, "c")}
    assert {tuple(r) for r in relational.upsert(old.filter("v <> 'b'"), new, "k").collect()} == {(1, "z"), (2, "c")}
    seen = frame(spark, [("a.txt", 3)], "filename string, file_size long")
    up = frame(spark, [("a.txt", 3), ("a.txt", 4), ("a.txt", 4), ("b.exe", 1), ("c.MD", 0)], "filename string, file_size long")
    assert [tuple(r) for r in relational.unseen_uploads(up, seen).collect()] == [("a.txt", 4)]
    best = frame(spark, [("x", 1.0, 1), ("x", 2.0, 2), ("x", 2.0, 3)], "name string, score double, at long")
    assert [tuple(r) for r in relational.keep_best(best, ["name"], "score", "at").collect()] == [("x", 2.0, 3)]


def test_text_functions(spark):
    one = frame(spark, [("Điện  Ảnh é", "v1.2 a-bc")], "t string, u string")
    r = one.select(T.fold(F.col("t")).alias("a"), T.fold(F.col("t"), False).alias("b"), T.sparse_tokens(F.col("u")).alias("s"), T.name_uuid(str(uuid.NAMESPACE_URL), F.col("u")).alias("id")).first()
    assert (r["a"], r["b"]) == ("đien anh e", "dien anh e")
    assert r["s"] == ["v1.2", "a-bc", "v1", "bc"]
    assert r["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "v1.2 a-bc"))
    v = one.select(T.hash_embedding(F.col("t")).alias("v")).first()["v"]
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_markdown_and_text_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\npara\nline\n\n## Two\n- item\n1. first\n```\ncode # x\n```\n# Three\nend", encoding="utf-8-sig")
    (tmp_path / "b.txt").write_bytes("caf\xe9\n\nsecond".encode("latin-1"))
    got = files.text_elements(files.raw_files(spark, tmp_path.as_uri())).orderBy("path", "element_no").collect()
    assert [(r["element_type"], r["heading_path"], r["text"]) for r in got] == [
        ("heading", "One", "One"), ("paragraph", "One", "para\nline"), ("heading", "One > Two", "Two"), ("list_item", "One > Two", "item"), ("list_item", "One > Two", "first"),
        ("code", "One > Two", "code # x"), ("heading", "Three", "Three"), ("paragraph", "Three", "end"), ("paragraph", "", "café"), ("paragraph", "", "second"),
    ]


def test_csv_tree(spark, tmp_path):
    path = tmp_path / "tree.csv"
    path.write_text("code,parent,name,level\nA,,Root,1\nB,A,Child,2\nB,A,Later,2\n,A,No code,2\nC,A,Bad,x\n", encoding="utf-8-sig")
    got = files.read_tree(spark, path.as_uri(), "code", "parent", "name", "level").orderBy("code").collect()
    assert [(r["code"], r["parent_code"], r["name"], r["level"]) for r in got] == [("A", None, "Root", 1), ("B", "A", "Later", 2)]
    with pytest.raises(ValueError):
        files.read_tree(spark, path.as_uri(), "code", "mother", "name", "level")


def test_partition_sink(spark, tmp_path):
    where = (tmp_path / "t").as_uri()
    files.append(frame(spark, [(1, "a"), (2, "b")], "v long, p string"), where, "p")
    files.replace_partitions(frame(spark, [(9, "b")], "v long, p string"), where, "p")
    assert {(r["v"], r["p"]) for r in spark.read.parquet(where).collect()} == {(1, "a"), (9, "b")}


def test_graph_expansion(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    got = {(r["node"], r["depth"]) for r in graph.expand(edges, frame(spark, [("a",)], "node string"), 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_conversation(spark):
    rows = frame(spark, [("How many items?",), ("what is this",), ("blacklist",), ("hello there",), ("doc 123",)], "text string")
    got = [(r["s"], r["c"]) for r in rows.select(conversation.strategy(F.col("text")).alias("s"), conversation.scope(F.col("text")).alias("c")).collect()]
    assert got == [("count", "document_question"), ("definition", "document_question"), ("general", "document_question"), ("general", "smalltalk"), ("general", "identifier_lookup")]
    turns = frame(spark, [(1, t, "user", f"m{t}") for t in range(6)], "conv_id long, turn long, role string, text string")
    assert conversation.last_messages(turns, 2).first()["context"] == "user: m4\nuser: m5"
    assert conversation.due_for_summary(turns, 4).count() == 0 and conversation.due_for_summary(turns, 3).count() == 1


def test_stream_equals_batch(spark, data, tmp_path):
    path = f"{data}/events.parquet"
    events = spark.read.parquet(path)
    cast = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in monitor.counts(cast(events)).collect()}
    folder = tmp_path / "in"
    events.repartition(3).write.parquet(folder.as_uri())
    stream = monitor.counts(cast(monitor.read_events(spark, folder.as_uri(), events.schema)), late="4000 days")
    running = stream.writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    assert {tuple(r) for r in spark.table("seen").collect()} == want
    gaps = frame(spark, [(1, datetime.datetime(2024, 1, 1, 0, m)) for m in (0, 10, 59)], "user_id long, ts timestamp")
    assert sorted(r["n"] for r in monitor.sessions(gaps).collect()) == [1, 2]


def test_server_sent_events():
    events = monitor.answer_events("two\nlines", ["1"])
    assert [e for e, _ in events] == ["metadata", "token", "citations", "done"]
    assert "event: token\ndata: two\ndata: lines\n\n" in monitor.server_sent(events)


def test_packing_is_greedy(spark):
    sizes = [4, 4, 4, 11, 3, 7, 1]
    rows = frame(spark, [("t", i, n) for i, n in enumerate(sizes)], "k string, at long, size long")
    got = [(r["first"], r["last"], r["total"]) for r in structure.pack(rows, "k", "at", "size", 10).orderBy("block").collect()]
    assert got == [(0, 1, 8), (2, 2, 4), (3, 3, 11), (4, 5, 10), (6, 6, 1)]


def test_answer_cleanup_and_gate(spark):
    one = frame(spark, [("<think>x\ny</think>Answer [1].\n\n\n\nSources:\nEnd",)], "t string")
    assert one.select(artifacts.clean_answer(F.col("t")).alias("t")).first()["t"] == "Answer [1].\n\nEnd"
    facts = artifacts.compile_identifiers(frame(spark, [(1, "no 12345678 on 12/11/2024 or 777")], "doc_id long, text string"))
    assert {r["canonical_text"] for r in facts.collect()} == {"12345678", "777"}
    assert artifacts.sufficient(artifacts.search(facts, ["1234"], 0.5, 5), 0.9) and not artifacts.sufficient(artifacts.search(facts, ["777"], 0.5, 5), 0.9)


def test_whole_terms(spark):
    docs = spark.createDataFrame([(1, "One two, three four five SIX seven"), (2, "one two three four five other"), (3, "xone two"), (None, "one two"), (4, None), (5, "one two"), (5, "one two")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "one two three four five six"), (2, "one two"), (3, "--"), (4, None), (2, "one two"), (5, "six"), (6, "two three four five six seven eight")], "item_id long, text string")
    got = Counter((r["item_id"], r["doc_id"]) for r in retrieval.whole_terms(docs, terms).collect())
    assert got == Counter([(1, 1), (2, 1), (2, 2), (2, None), (2, 5), (2, 5), (5, 1)])
    assert retrieval.whole_terms(docs, terms.filter("item_id = 3")).count() == 0
