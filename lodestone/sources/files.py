"""Sources and sinks: plain text, Markdown, CSV trees, HTML pages; replace and append."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_batches

ELEMENT = "path string, element_no long, element_type string, level long, heading_path string, text string"


def raw_files(spark: SparkSession, where: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of a folder's files, at any depth."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(where).select("path", "length", "content")


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def markdown_elements(text: str) -> Iterator[tuple[str, int, str, str]]:
    """(type, level, heading path, text) of headings, list items, fenced code and paragraphs."""
    path: list[tuple[int, str]] = []
    held: list[str] = []
    fenced: list[str] | None = None

    def where() -> str:
        return " > ".join(h for _, h in path)

    def flush() -> Iterator[tuple[str, int, str, str]]:
        if held:
            yield "paragraph", 0, where(), "\n".join(held)
            held.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if fenced is not None:
            if bare.startswith("```"):
                yield "code", 0, where(), "\n".join(fenced)
                fenced = None
            else:
                fenced.append(line)
        elif bare.startswith("```"):
            yield from flush()
            fenced = []
        elif bare.startswith("#") and bare.lstrip("#").startswith(" "):
            yield from flush()
            level = len(bare) - len(bare.lstrip("#"))
            path = [x for x in path if x[0] < level] + [(level, bare.lstrip("#").strip())]
            yield "heading", level, where(), path[-1][1]
        elif bare[:2] in ("- ", "* ", "+ ") or bare.split(". ", 1)[0].isdigit() and ". " in bare:
            yield from flush()
            yield "list_item", 0, where(), bare.split(" ", 1)[1].strip()
        elif bare:
            held.append(bare)
        else:
            yield from flush()
    yield from flush()
    if fenced:
        yield "code", 0, where(), "\n".join(fenced)


def text_elements(files: DataFrame) -> DataFrame:
    """Elements of (path, content) rows: Markdown by its marks, other text by blank lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = [(p, i, *e) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, e in enumerate(markdown_elements(decode(c or b"")) if (p or "").lower().endswith(".md") else (("paragraph", 0, "", part.strip()) for part in decode(c or b"").split("\n\n") if part.strip()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "element_no", "element_type", "level", "heading_path", "text"])

    return map_batches(files.select("path", "content"), run, ELEMENT)


def read_tree(spark: SparkSession, path: str, code: str, parent: str, name: str, level: str) -> DataFrame:
    """A CSV of tree rows (a byte-order mark is allowed): bad rows go, the last row of a code wins."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    clean = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    if missing := {code, parent, name, level} - set(clean.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = clean.select(F.trim(code).alias("code"), F.nullif(F.trim(parent), F.lit("")).alias("parent_code"), F.trim(name).alias("name"), F.col(level).try_cast("int").alias("level"), F.monotonically_increasing_id().alias("_at"))
    good = rows.filter("code <> '' AND name <> '' AND level IS NOT NULL")
    return good.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("_at")))).filter("_n = 1").drop("_n", "_at")


def page_summary(pages: DataFrame) -> DataFrame:
    """Title, link and heading counts of HTML rows, by regular expressions in the JVM."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return pages.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), count(r"<a\s").alias("n_links"), count(r"<h[1-6][\s>]").alias("n_headings"))


def append(rows: DataFrame, where: str, partition: str | None = None) -> None:
    """Append-only log sink."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(where)


def replace_partitions(rows: DataFrame, where: str, partition: str) -> None:
    """Replace exactly the partitions that ``rows`` has values of."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(where)
