"""Tables in text: detection, headers, records, parts of bounded size, continuation over pages, parents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enrich
from ..sources.shared import map_batches


def clean(cell: Column) -> Column:
    return F.trim(F.regexp_replace(cell, r"\s+", " "))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """(key, first_line, rows): runs of at least ``least`` adjacent lines with a pipe, as lists of cells; lines of dashes are no rows.

    Only lines with a pipe leave the row, and a run is found by its line number less its rank. Keys have to be unique.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(F.contains("line", F.lit("|")))
    runs = lines.withColumn("run", F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), clean)
    found = runs.groupBy(key, "run").agg(
        F.min("line_no").cast("long").alias("first_line"),
        F.array_sort(F.collect_list(F.when(~F.col("line").rlike(r"^[\s|:+-]*$"), F.struct("line_no", cells.alias("cells"))))).alias("rows"),
    )
    return found.filter(F.size("rows") >= least).select(key, "first_line", F.col("rows.cells").alias("rows"))


def padded(rows: Column) -> Column:
    """Rows with some text, all as wide as the widest."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    return F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def has_header(rows: Column) -> Column:
    """Whether the first of some padded rows heads the others: full, two cells or more, half of them with letters, and at least
    half of the columns unlike the three rows below it."""
    first, below = F.get(rows, F.lit(0)), F.slice(rows, 2, 3)
    lettered = F.size(F.filter(first, lambda c: c.rlike(r"\p{L}")))
    other = F.filter(F.transform(first, lambda c, i: F.struct(c.alias("head"), F.filter(F.transform(below, lambda r: F.get(r, i)), lambda v: v != "").alias("below"))), lambda x: (F.size(x["below"]) > 0) & ~F.array_contains(x["below"], x["head"]))
    full = (F.size(first) >= 2) & ~F.array_contains(first, "")
    return F.coalesce(full & (F.size(rows) > 1) & (2 * lettered >= F.size(first)) & (F.size(other) >= F.greatest(F.lit(1), F.floor(F.size(first) / 2))), F.lit(False))


def with_headers(tables: DataFrame) -> DataFrame:
    """``headers`` (cell_1, cell_2 and so on where there are none), ``headed``, and ``rows`` without them."""
    full = tables.withColumn("rows", padded(F.col("rows"))).filter(F.size("rows") > 0).withColumn("headed", has_header(F.col("rows")))
    names = F.transform(F.get("rows", F.lit(0)), lambda c, i: F.when(F.col("headed") & (c != ""), c).otherwise(F.concat(F.lit("cell_"), (i + 1).cast("string"))))
    return full.withColumn("headers", names).withColumn("rows", F.when(F.col("headed"), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))).otherwise(F.col("rows")))


def row_records(tables: DataFrame, table_id: Column, *keep: str) -> DataFrame:
    """(keep, row_index, content): one record a row, every cell under its header."""
    fields = F.array_join(F.zip_with("headers", "cells", lambda h, c: F.concat(h, F.lit(": "), c)), " | ")
    rows = tables.select("*", F.posexplode("rows").alias("at", "cells"))
    index = (F.col("at") + 1).cast("long")
    return rows.select(*keep, index.alias("row_index"), F.concat(F.lit("TABLE_ROW table_id="), table_id, F.lit(" row="), index.cast("string"), F.lit(" | "), fields).alias("content"))


def supporting_records(tables: DataFrame, table_id: Column, title: Column, *keep: str) -> DataFrame:
    """(keep, chunk_type, content): a title record where there is a title, and a header record."""
    named = F.when(clean(title) != "", F.struct(F.lit("table_title").alias("chunk_type"), F.concat(F.lit("TABLE_TITLE table_id="), table_id, F.lit(": "), clean(title)).alias("content")))
    head = F.struct(F.lit("table_header").alias("chunk_type"), F.concat(F.lit("TABLE_HEADER table_id="), table_id, F.lit(" | "), F.array_join("headers", " | ")).alias("content"))
    return tables.select(*keep, F.explode(F.array_compact(F.array(named, head))).alias("r")).select(*keep, "r.*")


def parts(tables: DataFrame, limit: int, *keep: str) -> DataFrame:
    """(keep, part, first_row, last_row, n_tokens): rows in order under a repeated header, each part within ``limit`` tokens
    (a longer row is a part of its own). The fold runs inside one table's list."""
    count = lambda cells: enrich.token_count(F.array_join(cells, " | "))
    sizes = F.transform("rows", lambda r: count(r).cast("long"))
    none = F.array().cast("array<struct<first: bigint, last: bigint, total: bigint>>")

    def step(done: Column, size: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        row = F.coalesce(last["last"], F.lit(0)) + 1
        joins = last.isNotNull() & (last["total"] + size <= limit)
        more = F.array(F.struct(last["first"].alias("first"), row.alias("last"), (last["total"] + size).alias("total")))
        new = F.array(F.struct(row.alias("first"), row.alias("last"), (F.col("head") + size).alias("total")))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), more)).otherwise(F.concat(done, new))

    cut = tables.withColumn("head", count(F.col("headers")).cast("long")).select(*keep, F.posexplode(F.aggregate(sizes, none, step)).alias("part", "p"))
    return cut.select(*keep, (F.col("part") + 1).cast("long").alias("part"), F.col("p.first").alias("first_row"), F.col("p.last").alias("last_row"), F.col("p.total").alias("n_tokens"))


def continued(rows: DataFrame, document: str, signature: str, order: str, page: str, fill: str) -> DataFrame:
    """Rows of tables that go on over pages: a blank ``fill`` takes the value above it, as long as the header is the same and no
    page lies between; ``group_no`` numbers such groups from 1 within a document and a header."""
    w = Window.partitionBy(document, signature).orderBy(order)
    begins = F.coalesce(F.col(page) - F.lag(page).over(w) > 1, F.lit(True))
    grouped = rows.withColumn("group_no", F.sum(begins.cast("long")).over(w))
    above = Window.partitionBy(document, signature, "group_no").orderBy(order)
    return grouped.withColumn(fill, F.last(F.nullif(F.trim(fill), F.lit("")), ignorenulls=True).over(above))


def parents(children: DataFrame, document: str, name: str, order: str, fields: str, first: str, last: str) -> DataFrame:
    """(document, name, n_parts, fields, first_row, last_row): one parent for every table of more than one part, names compared in
    lower case and shown as in the first part; tables without a name have no parent."""
    named = children.filter(F.trim(name) != "")
    whole = named.groupBy(document, F.lower(name).alias("_name")).agg(
        F.min_by(name, order).alias(name), F.count("*").alias("n_parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(fields)))).alias(fields), F.min(first).alias("first_row"), F.max(last).alias("last_row"))
    return whole.filter("n_parts > 1").drop("_name")


def misfiled(children: DataFrame, parent_tables: DataFrame, parent_key: str, key: str, name: str) -> DataFrame:
    """Children whose parent is missing or bears another table name (in either case): they are to be unlinked."""
    p = parent_tables.select(F.col(key).alias(parent_key), F.lower(name).alias("_parent"))
    linked = children.filter(F.col(parent_key).isNotNull()).join(p, parent_key, "left")
    return linked.filter(~F.lower(name).eqNullSafe(F.col("_parent")) | F.col("_parent").isNull()).drop("_parent")


#: A cell of a line with columns ends before two white spaces or at the line's end.
_CELL = re.compile(r"\S(?:.*?\S)??(?=\s{2,}|\s*$)")
_DASHES = re.compile(r"[\s|:+-]*")


def cells_of(line: str) -> list[tuple[int, str]]:
    """(column, cell) of a line whose cells are two or more white spaces, or a tab, apart."""
    return [(m.start(), m.group()) for m in _CELL.finditer(line.expandtabs(4))]


def column_starts(rows: list[list[tuple[int, str]]], apart: int = 3) -> list[int]:
    """The columns of some lines: all cells' starts in order, cut where two are more than ``apart`` away, each group's median; groups of one cell are columns only if no larger ones exist."""
    groups: list[list[int]] = []
    for x in sorted(a for row in rows for a, _ in row):
        if groups and x - groups[-1][-1] <= apart:
            groups[-1].append(x)
        else:
            groups.append([x])
    many = [g for g in groups if len(g) > 1] or groups
    return [int(median(g)) for g in many]


def placed(rows: list[list[tuple[int, str]]], starts: list[int]) -> list[list[str]]:
    """The cells of each line by their nearest column; a line that has nothing in the first column goes on with the row before it."""
    out: list[list[str]] = []
    for row in rows:
        cells = [""] * len(starts)
        for at, cell in row:
            i = min(range(len(starts)), key=lambda k: (abs(starts[k] - at), k))
            cells[i] = f"{cells[i]} {cell}".strip()
        if out and not cells[0]:
            out[-1] = [f"{a} {b}".strip() for a, b in zip(out[-1], cells, strict=True)]
        else:
            out.append(cells)
    return out


def regions_of(text: str, least: int = 2) -> list[tuple[str, int, int, list[list[str]]]]:
    """(kind, start, end, rows) of a text's tables, in order: ``pipe``, adjacent lines with a pipe, of which ``least`` are more than dashes; ``aligned``, lines of two cells or more with
    indented lines between them and single blank lines, of which ``least`` have two cells. Offsets are code points, from the first line's start to the last one's end."""
    out, at, held, kind, blank = [], 0, [], "", 0

    def ended() -> None:
        nonlocal held, blank
        if kind == "pipe":
            rows = [[re.sub(r"\s+", " ", c).strip() for c in re.sub(r"^\||\|$", "", line.strip()).split("|")] for _, line in held if not _DASHES.fullmatch(line)]
            good = len(rows) >= least
        else:
            parts = [cells_of(line) for _, line in held]
            good = sum(len(p) > 1 for p in parts) >= least
            rows = placed(parts, column_starts(parts)) if good else []
        if good:
            out.append((kind, held[0][0], held[-1][0] + len(held[-1][1]), rows))
        held, blank = [], 0

    for line in text.split("\n"):
        found = "pipe" if "|" in line else "aligned" if line.strip() and len(cells_of(line)) > 1 else ""
        if held and (found and found != kind or found == "" and kind == "pipe"):
            ended()
        if found:
            kind, blank = found, 0
            held.append((at, line))
        elif held and not line.strip():
            blank += 1
            if blank > 1:
                ended()
        elif held and line[:1].isspace():
            held.append((at, line))
            blank = 0
        elif held:
            ended()
        at += len(line) + 1
    if held:
        ended()
    return out


def regions(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """(key, kind, start, end, rows) of every table in the texts; null and empty texts have none. One pass over a text's lines."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in regions_of(body or "", least)]
            types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names=["key", "kind", "start", "end", "rows"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(plain, run, f"key {kind}, kind string, start long, end long, rows array<array<string>>").withColumnRenamed("key", key)


def uncovered(lengths: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, start, end): what ``ranges`` (key, start, end) leave of 0 to ``n`` (key, n), by one sweep over each key's ranges in order.

    Ranges may meet, overlap and lie in each other; empty ones cover nothing, and what lies beyond ``n`` is cut off. Null keys are a key.
    """
    ends = lengths.select(key, F.col("n").cast("long").alias("start"), F.col("n").cast("long").alias("end"), F.col("n").cast("long").alias("n"))
    all_ = ranges.filter(F.col("end") > F.col("start")).select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(None).cast("long").alias("n")).unionByName(ends)
    whole, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = all_.select(key, F.coalesce(F.max("end").over(before), F.lit(0).cast("long")).alias("a"), "start", F.max("n").over(whole).alias("size"))
    return gaps.select(key, F.greatest("a", F.lit(0)).alias("start"), F.least("start", "size").alias("end")).filter(F.col("end") > F.col("start"))


def prose_and_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start, end, part) that cover every text without overlap: its tables, and ``prose`` between them. Keys have to be unique."""
    found = regions(docs, key, text).select(key, "kind", "start", "end")
    prose = uncovered(docs.select(key, F.coalesce(F.length(text), F.lit(0)).alias("n")), found, key).select(key, F.lit("prose").alias("kind"), "start", "end")
    lists = found.unionByName(prose).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__parts")).withColumnRenamed(key, "__key")
    rows = docs.select(F.col(key), F.col(text).alias("__text")).join(lists, F.col(key).eqNullSafe(F.col("__key")))
    cut = rows.select(key, "__text", F.explode("__parts").alias("p"))
    return cut.select(key, "p.kind", "p.start", "p.end", F.substring("__text", (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int")).alias("part"))


def rewritten(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every table in place as its records, one a row under its headers, and prose trimmed; parts a blank line apart. Keys have to be unique."""
    parts_ = prose_and_tables(docs, key, text)
    cells = with_headers(regions(docs, key, text).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("start"))))
    records = row_records(cells, F.concat(F.lit("t"), F.col("n").cast("string")), key, "start")
    tables_ = records.groupBy(key, "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "content"))), lambda r: r["content"]), "\n").alias("said"))
    prose = parts_.filter("kind = 'prose'").select(key, "start", F.regexp_replace("part", r"\A\s+|\s+\z", "").alias("said"))
    said = prose.unionByName(tables_).filter("said <> ''").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "said"))), lambda r: r["said"]), "\n\n").alias("__said")).withColumnRenamed(key, "__key")
    return docs.select(key).join(said, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.coalesce("__said", F.lit("")).alias(text))
