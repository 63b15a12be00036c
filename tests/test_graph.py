"""Entities and relations from text, and what queries reach over them; phrases by places."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, index, scan
from lodestone.sources import shared

KINDS = {"article": (r"Article\s+\d+", 0.95), "org": (r"ACME|Initech", 0.85)}
TEXTS = [(1, "ACME and article 9, Article 5 and Article 5"), (2, "Article 5 of Initech"), (3, "Initech, again Initech"), (4, "ACME alone"), (5, None), (6, ""), (7, "Article 70 with ACME"), (8, "Article 70 here")]


def test_extraction(spark):
    chunks = spark.createDataFrame(TEXTS, "id int, text string").withColumn("name", F.lit("clash"))
    found = graph.extracted(chunks, "id", "text", KINDS, 3)
    by = {r["id"]: [(m["normalized"], m["type"]) for m in r["found"]] for r in found.collect()}
    assert by[1] == [("article 5", "article"), ("article 5", "article"), ("acme", "org")] and by[5] == by[6] == [] and by[4] == [("acme", "org")]
    mentions, nodes, edges = graph.graph_of(found, "id")
    assert mentions.filter("id = 1").count() == 2 and nodes.count() == 4
    assert {(r["a"], r["b"], r["n_found"]) for r in edges.collect()} == {("article 5", "article 5", 1), ("article 5", "initech", 1), ("initech", "initech", 1), ("article 70", "acme", 1)}


def plain_reach(mentions, edges, seeds, terms, depth):
    level = {n for k, n in mentions if k in seeds} | {n for _, n in mentions if any(t in n for t in terms if len(t) >= 3)}
    found = set(level)
    for _ in range(depth):
        level = {b for a, b in edges if a in level} | {a for a, b in edges if b in level}
        found |= level
    return Counter(k for k, n in mentions if n in found and k not in seeds)


def test_expansion(spark):
    chunks = spark.createDataFrame(TEXTS, "id int, text string")
    mentions, nodes, edges = graph.graph_of(graph.extracted(chunks, "id", "text", KINDS), "id")
    pairs = [(r["id"], r["normalized"]) for r in mentions.collect()]
    links = [(r["a"], r["b"]) for r in edges.collect()]
    seeds = {"x": {2}, "y": {4}, "z": set(), "w": {5}}
    terms = {"x": [], "y": ["ar"], "z": ["Cle 7", "nothing"], "w": []}
    s = spark.createDataFrame([(q, i) for q, ids in seeds.items() for i in ids], "asked string, id int")
    t = spark.createDataFrame([(q, w) for q, ws in terms.items() for w in ws], "asked string, term string")
    for depth in (0, 1, 2, 3):
        got = graph.expanded_chunks(mentions, nodes, edges, s, t, "asked", "id", depth).collect()
        for q in seeds:
            assert Counter({r["id"]: r["score"] for r in got if r["asked"] == q}) == plain_reach(pairs, links, seeds[q], [w.lower() for w in terms[q]], depth), (q, depth)
    assert graph.expanded_chunks(mentions, nodes, edges, s, t, "asked", "id", 1, chunks.limit(0)).count() == 0


@pytest.mark.parametrize("state, row", [(64 << 20, 1 << 16), (64, 7)])
def test_best_chunks(spark, monkeypatch, state, row):
    """The first of ``expanded_chunks``, with one block and with many, at every depth; queries with two seeds, with none and with terms alone; ties go by key."""
    monkeypatch.setattr(graph, "STATE_BYTES", state)
    monkeypatch.setattr(graph, "ROW", row)
    monkeypatch.setattr(graph, "BLOCKS", 1)
    rng = random.Random(3)
    texts = [(f"c{i}" if i else None, " ".join(f"N{rng.choice([rng.randint(0, 9), rng.randint(0, 200)])}" for _ in range(rng.randint(0, 9)))) for i in range(300)]
    chunks = spark.createDataFrame(texts, "id string, text string").repartition(3)
    mentions, nodes, edges = graph.graph_of(graph.extracted(chunks, "id", "text", {"n": (r"N\d+", 0.9)}), "id")
    seeds = spark.createDataFrame([(q, f"c{rng.randint(1, 299)}") for q in range(90) for _ in range(1 + q % 2)], "asked int, id string")
    terms = spark.createDataFrame([(q, f"N{rng.randint(10, 99)}") for q in range(80, 100)] + [(99, "N1")], "asked int, term string")
    for depth in (0, 1, 2):
        scored = graph.expanded_chunks(mentions, nodes, edges, seeds, terms, "asked", "id", depth)
        wanted = index.best(scored, "asked", 6, F.desc("score"), F.col("id")).collect()
        got = graph.best_chunks(mentions, nodes, edges, seeds, terms, "asked", "id", depth, 6).collect()
        assert Counter((r["asked"], r["id"], r["score"], r["rank"]) for r in got) == Counter((r["asked"], r["id"], r["score"], r["rank"]) for r in wanted) and len(wanted) > 300


def test_best_chunks_moves_no_pairs(spark, monkeypatch):
    """Queries that reach everything: rows that move are links and mentions for each block, not pairs of queries and chunks."""
    moved = []
    monkeypatch.setattr(graph, "map_batches", lambda rows, run, schema: moved.append(rows) or shared.map_batches(rows, run, schema))
    chunks = spark.range(2000).select(F.col("id"), F.concat(F.lit("N1 N"), (F.col("id") % 50).cast("string")).alias("text"))
    mentions, nodes, edges = graph.graph_of(graph.extracted(chunks, "id", "text", {"n": (r"N\d+", 0.9)}), "id")
    seeds = chunks.filter("id % 10 = 0").select(F.col("id").alias("asked"), "id")
    got = graph.best_chunks(mentions, nodes, edges, seeds, seeds.select("asked", F.lit("none").alias("term")), "asked", "id", 2, 3)
    assert sorted(r["id"] for r in got.filter("asked = 0").collect()) == [2, 3, 4] and got.count() == 600
    assert moved[-1].count() < 100


def test_phrase_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b c a b"), (2, "a-B; c"), (3, "b a"), (4, None), (5, "c c c c")], "doc_id int, text string")
    asked = spark.createDataFrame([("p", "a b"), ("q", "c c"), ("r", "?"), ("s", "b c"), ("t", "a absent"), ("p", "b a")], "q string, said string")
    built = index.Index.build(docs, buckets=3)
    for limit in (1000, 1):
        monkeypatch.setattr(index, "LITERALS", limit)
        got = Counter(map(tuple, built.phrase_counts(asked, "q", "said").collect()))
        assert got == Counter([("p", 1, 3), ("p", 2, 1), ("q", 5, 3), ("s", 1, 1), ("s", 2, 1), ("p", 1, 1), ("p", 3, 1)])


@pytest.mark.parametrize("small", [False, True])
def test_scans_equal_the_index(spark, monkeypatch, small):
    """Phrases and covers by one pass, over one block of queries and over many, against the index; ties, repeated words and names, and texts without words. No folder is written but the queries'."""
    if small:
        for name, value in (("ASKED", 7), ("PAIRS", 5), ("PLACES", 9), ("WORDS", 11)):
            monkeypatch.setattr(scan, name, value)
    rng = random.Random(8)
    some = lambda n, m: " ".join(rng.choice("abcdefgh"[:n]) for _ in range(m))
    docs = spark.createDataFrame([(f"d{i}", some(rng.randint(1, 8), rng.randint(0, 40))) for i in range(60)] + [("null", None), ("mark", "?!")], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, some(8, rng.randint(1, 4))) for i in range(40)] + [(40, "a a b"), (41, "?"), (42, None), (43, "z a"), (44, "A b")], "q int, said string")
    built = index.Index.build(docs, buckets=3)
    wanted = Counter(map(tuple, built.phrase_counts(asked, "q", "said").collect()))
    assert Counter(map(tuple, scan.phrases(docs, asked, "q", "said").collect())) == wanted and len(wanted) > 100
    scored = built.cover_scores(asked, "q", "said").withColumn("score", F.round("score", 6))
    wanted = Counter(map(tuple, index.best(scored, "q", 5, F.desc("score"), F.col("doc_id")).collect()))
    monkeypatch.setattr(index.Index, "build", None)
    assert Counter(map(tuple, scan.best_covers(docs, asked, "q", "said", 5).collect())) == wanted and len(wanted) > 100
    twice = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a")], "q int, said string")
    once = scan.best_covers(docs, spark.createDataFrame([(1, "c b a")], "q int, said string"), "q", "said", 5).collect()
    assert Counter(map(tuple, scan.best_covers(docs, twice, "q", "said", 5).collect())) == Counter(map(tuple, once)) and len(once) == 5
    assert scan.phrases(docs, twice.filter("q > 1"), "q", "said").count() == 0


def test_query_sets_move_no_postings(spark, data, monkeypatch):
    """The queries over sets of texts build no index, of which every posting would be shuffled and written."""
    from lodestone.plans import queries as plans

    monkeypatch.setattr(index.Index, "build", None)
    monkeypatch.setattr(index, "_built", {})
    for name in ("keyword_covers", "keyword_exact_terms"):
        assert plans.queries()[name](spark, data).count() > 0
