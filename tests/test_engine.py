"""The service facade end to end on a folder of files."""

from pyspark.sql import functions as F

from lodestone.operators import access
from lodestone.plans.engine import Engine


def test_engine(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "tea.txt").write_text("Green tea brewing takes 80 degrees.\n\nOrder 123456 covers green tea from the hills.")
    (inbox / "coffee.md").write_text("# Coffee\n\nCoffee roasting is slow. Order 777888 covers beans.")
    (inbox / "latin.txt").write_bytes("caf\xe9 menu".encode("latin-1"))
    (inbox / "skip.bin").write_bytes(b"\x00")
    e = Engine(spark, (tmp_path / "db").as_uri())
    assert e.table("chunks").count() == 0
    assert e.upload(inbox.as_uri()).count() == 3
    assert e.upload(inbox.as_uri()).count() == 0  # the same names and sizes
    assert [r["filename"] for r in e.documents().collect()] == ["coffee.md", "latin.txt", "tea.txt"]
    assert e.table("chunks").filter(F.col("content") == "café menu").count() == 1

    first = e.rerank("green tea brewing").first()
    assert "Green tea" in first["content"] and first["rank"] == 1 and abs(first["score"] - 1) < 1e-9
    assert e.table("retrieval_log").count() > 0
    assert "777888" in e.hybrid("order 777888", 1).first()["content"]
    assert e.facts(["7788"]).first()["canonical_text"] == "777888"
    assert e.context("green tea", budget=5).count() == 0 and e.context("green tea").first()["citation"] == 1
    assert e.keyword("the of").count() == 0

    files = {r["filename"]: r["document_id"] for r in e.table("files").collect()}
    rows = [(files["tea.txt"], "public"), (files["coffee.md"], "private")]
    resources = spark.createDataFrame(rows, "document_id string, visibility string")
    for name, kind in (("classification", "int"), ("organization", "string"), ("org_path", "string"), ("owner", "string"), *((f"{a}_{b}", "array<string>") for a in ("denied", "allowed") for b in ("users", "roles"))):
        resources = resources.withColumn(name, F.lit(None).cast(kind))
    scope = e.allowed(resources, access.Subject(user="u"))
    assert e.sparse("coffee roasting", scope=scope).count() == 0 and e.sparse("coffee roasting").count() == 1

    e.delete(files["coffee.md"])
    assert e.sparse("coffee roasting").count() == 0 and e.facts(["7788"]).count() == 0 and e.documents().count() == 2

    e.remember("u", "likes Tea")
    e.remember("u", "likes quiet")
    assert [r["content"] for r in e.memories("u", "tea").collect()] == ["likes Tea"]
    e.forget("u", 1)
    assert [r["id"] for r in e.memories("u").collect()] == [2] and e.memories("v").count() == 0
