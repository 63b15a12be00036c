"""Chunkers: sequential text splitting as Arrow batches, one output row a chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import map_batches

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def windows(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Ranges of a text: each ends after the last separator that begins in the window's final 15 per cent, by the first kind
    that has one, else at the window's end; the next starts ``overlap`` before it, and at least one character on. Blank texts have none."""
    start, n = 0, len(text)
    while start < n and (start or text.strip()):
        limit = min(n, start + size)
        end = limit
        if limit < n:
            for mark in separators:
                at = text.rfind(mark, start, limit)
                if at - start >= max(1, (limit - start) * 85 // 100):
                    end = at + len(mark)
                    break
        yield start, end
        if end >= n:
            return
        start = max(end - overlap, start + 1)


def split(docs: DataFrame, size: int = 1000, overlap: int = 150, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, start, end, chunk) of every row that is not blank."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(k, i, a, b, body[a:b]) for i, (a, b) in enumerate(windows(body or "", size, overlap))]
                if len(rows) > 20_000:
                    yield from _table(rows, batch.schema.field(0).type)
                    rows = []
            yield from _table(rows, batch.schema.field(0).type)

    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, chunk_index long, start long, end long, chunk string").withColumnRenamed("key", key)


def _table(rows: list[tuple], key: pa.DataType) -> list[pa.RecordBatch]:
    if not rows:
        return []
    kinds = (key, pa.int64(), pa.int64(), pa.int64(), pa.string())
    return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "chunk_index", "start", "end", "chunk"])]


def pipe_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """(key, line_no, n_cells, cells) of lines that are rows of a pipe table."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(F.contains("line", F.lit("|")))
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = lines.withColumn("cells", cells).filter(F.size("cells") >= least)
    return rows.select(key, F.col("line_no").cast("long").alias("line_no"), F.size("cells").cast("long").alias("n_cells"), F.concat(F.lit("TABLE_ROW "), F.array_join("cells", " | ")).alias("record"))


def missing_lines(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_missing): a row's lines with text, and those that its chunks' ranges do not cover. Keys have to be unique.

    Only offsets are compared. Ranges that meet or overlap are one, so that a line over a boundary is covered; a line is covered by the last
    such range that begins before it or with it, or by none: one sweep over ranges and lines in order.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    upto = Window.partitionBy(key).orderBy("no")
    end = F.sum(F.length("line") + 1).over(upto) - 1
    lines = lines.select(key, (end - F.length("line")).cast("long").alias("start"), end.cast("long").alias("end"), (F.trim("line") != "").alias("full"))
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ranges = chunks.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    fresh = (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    islands = ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(Window.partitionBy(key).orderBy("start", "end"))).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # Ranges come before the lines that begin where they do.
    events = islands.select(key, "start", F.lit(0).alias("kind"), F.col("end").alias("covered"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("boolean").alias("full")).unionByName(lines.select(key, "start", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("covered"), "end", "full"))
    reached = F.coalesce(F.last("covered", ignorenulls=True).over(Window.partitionBy(key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    marked = events.withColumn("lost", F.col("end") > reached).filter("kind = 1")
    return marked.groupBy(key).agg(F.count_if("full").alias("n_lines"), F.count_if(F.col("full") & F.col("lost")).alias("n_missing"))
