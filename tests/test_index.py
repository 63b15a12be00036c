"""The positional index against plain scans, and what it reads; code shipped to workers; a channel that fails when it runs."""

import os
import subprocess
import sys
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, retrieval
from lodestone.sources import shared

from .conftest import DATA, ROOT

TEXTS = [(1, "alpha beta gamma alpha"), (2, "beta x x alpha y beta"), (3, None), (4, ""), (5, "Alpha, BETA! gamma-ray"), (6, "gammas alphabeta"), (7, "... --- ..."), (8, "ra y alpha-\nbeta " * 300)]


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("term", F.lit("clash")).withColumn("bucket", F.lit("clash")).repartition(3)
    return docs, index.Index.build(docs, buckets=4)


def words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def plain_covers(text, query):
    """All stretches with every word of the query that hold no shorter one, and their worth."""
    w, wanted = words(text), set(words(query))
    at = [i for i, x in enumerate(w) if x in wanted]
    full = [(a, b) for a in at for b in at if a <= b and set(w[a : b + 1]) >= wanted]
    least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return len(least), sum(0.1 / (1 + sum(x not in wanted for x in w[a : b + 1])) for a, b in least)


def test_postings(built):
    rows = built[1].all().collect()
    want = {(k, t): [i for i, x in enumerate(words(text)) if x == t] for k, text in TEXTS for t in words(text)}
    assert {(r["key"], r["term"]): r["places"] for r in rows} == want
    assert all(r["n_words"] == len(words(dict(TEXTS)[r["key"]])) for r in rows)
    assert all(abs(sum(r["weight"] ** 2 for r in rows if r["key"] == k) - 1) < 1e-9 for k in (1, 2, 5, 8))
    assert {(r["term"], r["n_docs"]) for r in built[1].vocabulary().collect()} == set(Counter(t for _, t in want).items())


def test_only_the_terms_folders_are_read(built):
    plan = built[1].postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket#" in plan and "EqualTo(term,alpha)" in plan
    assert {r["term"] for r in built[1].postings(["alpha", "beta", "absent"]).select("term").collect()} == {"alpha", "beta"}
    assert built[1].postings([]).count() == 0
    terms = built[1].vocabulary().filter("term = 'gamma'")
    assert {r["key"] for r in built[1].postings(terms).collect()} == {1, 5}


def test_buckets_of_terms(spark):
    terms = ["", "a", "đường", "x" * 100, "😀"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", index._bucket(F.col("t"), 97).alias("b")).collect()
    assert {r["t"]: r["b"] for r in rows} == {t: index._bucket_of(t, 97) for t in terms}


def test_cover_scores(spark, built, monkeypatch):
    asked = [("q1", "alpha beta"), ("q2", "beta alpha Beta"), ("q3", "..."), ("q4", "absent alpha"), ("q5", None), ("q6", "alpha"), ("q1", "gamma")]
    queries = spark.createDataFrame(asked, "q string, said string")
    want = Counter()
    for q, said in asked:
        for k, text in TEXTS:
            if words(said) and set(words(said)) <= set(words(text)):
                n, score = plain_covers(text, said) if k != 8 else (None, None)
                want[(q, k, n, None if score is None else round(score, 9))] += 1
    for limit in (1000, 1):  # terms by name, and joined
        monkeypatch.setattr(index, "LITERALS", limit)
        got = Counter((r["q"], r["doc_id"], None if r["doc_id"] == 8 else r["n_covers"], None if r["doc_id"] == 8 else round(r["score"], 9)) for r in built[1].cover_scores(queries, "q", "said").collect())
        assert got == want


@pytest.mark.parametrize("limit", [1000, 1])
def test_keyword_scores_equal_a_scan(built, monkeypatch, limit):
    docs, built_index = built
    monkeypatch.setattr(index, "LITERALS", limit)
    for terms, phrases in ((["alpha", "beta"], []), (["alpha"], ["ma-ra", "a beta"]), ([], ["beta"]), (["x", "absent"], ["alpha-\nbeta", "ALPHA, b"])):
        want = retrieval.keyword_scores(docs, terms or ["\x00"], phrases, "text").select("doc_id", "n_exact", F.round("score", 9)).collect()
        got = built_index.keyword_scores(docs, terms, phrases).select("doc_id", "n_exact", F.round("score", 9)).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)), (terms, phrases)
    with pytest.raises(ValueError):
        built_index.near_phrases(["--"])


def test_sparse_scores_equal_a_scan(built):
    docs, built_index = built
    for query in ("alpha beta alpha", "absent", "!"):
        want = retrieval.sparse_scores(docs, query).filter("score > 0").collect()
        got = built_index.sparse_scores(query).collect()
        assert sorted((r[0], round(r[1], 9)) for r in got) == sorted((r[0], round(r[1], 9)) for r in want)


def test_index_is_kept_for_a_state_of_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/d")
    read = lambda: spark.read.parquet(f"{tmp_path}/d")
    first = index.index_of(read())
    assert index.index_of(read()) is first and first.all().count() == 2
    rows.write.mode("append").parquet(f"{tmp_path}/d")
    assert index.index_of(read()) is not first and index.index_of(read()).all().count() == 4
    assert index.Index.build(rows.limit(0)).all().count() == 0


def test_degraded_when_a_task_fails(spark):
    keyword = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank long")
    good = spark.createDataFrame([(2, 1)], "doc_id long, rank long")
    fused, failed = retrieval.degraded(lambda: good, keyword, "doc_id")
    assert not failed and fused.count() == 2 and fused.filter("doc_id = 2").first()["flags"] == "vector+keyword"
    lost = good.withColumn("rank", F.when(F.col("rank") > 0, F.raise_error(F.lit("store is lost")).cast("long")))
    fused, failed = retrieval.degraded(lambda: lost, keyword, "doc_id")
    assert failed and {r["flags"] for r in fused.collect()} == {"keyword"}
    fused, failed = retrieval.degraded(lambda: spark.read.parquet("/nowhere/at/all"), keyword, "doc_id")
    assert failed
    with pytest.raises(ZeroDivisionError):  # an error of the caller's own is no lost store
        retrieval.degraded(lambda: 1 / 0, keyword, "doc_id")


def test_vector_sets(spark):
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0], None if i % 4 == 0 else i % 4) for i in range(60)] + [(60, None, 1), (61, [0.0, 0.0, 0.0], 1)]
    points = spark.createDataFrame(rows, "k string, v array<float>, g int").repartition(3)
    asked = points.filter("k IN ('3', '60', '7', '61')")
    import numpy as np

    unit = {str(k): np.array(v) / np.linalg.norm(v) for k, v, _ in rows[:60]}
    for group in (None, "g"):
        got = retrieval.top_of_set(points, asked, 4, "k", "v", block=8, group=group).collect()
        for q in ("3", "7"):
            for g in {r[2] for r in rows} if group else {0}:
                mine = sorted((-round(float(unit[q] @ unit[str(k)]), 6), str(k)) for k, _, own in rows[:60] if not group or own == g)[:4]
                found = sorted((r["rank"], r["k"], r["score"]) for r in got if r["query"] == q and (not group or r["g"] == g))
                assert [(-s, k) for _, k, s in found] == mine
        assert {r["query"] for r in got} == {"3", "7"}
    plan = retrieval.top_of_set(points, asked, 4, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_queries_run_where_workers_lack_the_package(tmp_path):
    """From an empty folder, with the package on the driver's path only."""
    script = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {tmp_path.as_uri()!r}).getOrCreate()
        import __spark_entry__
        queries = __spark_entry__.queries()
        for name in ("recursive_chunks", "sparse_vectors", "sparse_vector_search", "vector_topk_set", "keyword_covers", "vector_per_label_set"):
            assert queries[name](spark, {DATA!r}).count() > 0, name
        from lodestone.plans.engine import Engine
        spark.createDataFrame([("some words of a text",)], "value string").coalesce(1).write.text({(tmp_path / "inbox").as_uri()!r})
        assert Engine(spark, {(tmp_path / "engine").as_uri()!r}).upload({(tmp_path / "inbox").as_uri()!r}).count() == 1
        print("all ran")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_state_of_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/s")
    assert shared.state_of(spark.read.parquet(f"{tmp_path}/s")) == shared.state_of(spark.read.parquet(f"{tmp_path}/s"))
