"""Records that fit a token limit: prose split by blocks, hard splits at sentence ends, tables packed and their tails evened out.

A token is a run of word characters or a run of others that are no white space, so tokens never cross a line and counts of lines add up. Splits are chosen
from counts and marks, in one pass over a document's tokens in Arrow batches; what leaves a task are ranges of its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import map_batches

#: What a token is, the ends of sentences, the least budget, the tokens kept free, the share of the limit that a hard split fills, the part of it without preferred ends.
TOKEN = r"\w+|[^\w\s]+"
ENDS = ".!?;:"
LEAST, FREE, SHARE, EARLY = 32, 16, 0.85, 0.55
#: The least rows and tokens of a table's last part, the latter at least this share of the limit.
TAIL_ROWS, TAIL_TOKENS, TAIL_SHARE = 2, 72, 0.30

_TOKEN = re.compile(TOKEN)


def budget(limit: int) -> int:
    """The tokens of a hard split's part: a limit of 32 or less leaves nothing free."""
    return min(limit, max(LEAST, min(limit - FREE, int(limit * SHARE))))


def hard_cuts(good: np.ndarray, size: int) -> list[int]:
    """Ends of parts of ``size`` tokens at most: each is the last place in the part's final 45 per cent where ``good[i]`` allows token i to begin a part, else its full size."""
    n, early = len(good), max(1, int(size * EARLY))
    last = np.maximum.accumulate(np.where(good, np.arange(n), -1)) if n else good
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        if end < n and last[end] > min(end - 1, start + early):
            end = int(last[end])
        out.append(end)
        start = end
    return out


def tokens_of(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(start, end) of every token, and whether a part may begin at it: the token before ends a sentence or a line, and it begins with no small letter."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    good = np.zeros(len(spans), bool)
    for i in range(1, len(spans)):
        (_, end), (start, _) = spans[i - 1], spans[i]
        good[i] = (text[end - 1] in ENDS or "\n" in text[end:start]) and not text[start].islower()
    return spans, good


def hard_parts(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of a text's parts, from a first token to a last one."""
    spans, good = tokens_of(text)
    cuts = [len(spans)] if 0 < len(spans) <= limit else hard_cuts(good, budget(limit))
    return [(spans[a][0], spans[b - 1][1], b - a) for a, b in zip([0, *cuts][:-1], cuts, strict=True)]


def packed(costs: list[int], limit: int, fixed: int = 0) -> list[int]:
    """The part of each item, packed in order: a part is ended by the item that would bring ``fixed`` and its items above the limit."""
    out, part, used = [], 0, 0
    for i, n in enumerate(costs):
        if i and fixed + used + n > limit:
            part, used = part + 1, 0
        out.append(part)
        used += n
    return out


def blocks_of(text: str, is_heading: Callable[[str], bool]) -> tuple[list[str], list[str]]:
    """(the headings that begin a text, its other lines); blank lines are left out. A text of headings alone has only lines."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = next((i for i, x in enumerate(lines) if not is_heading(x)), 0)
    return lines[:n], lines[n:]


def fitted(text: str, limit: int, is_heading: Callable[[str], bool]) -> list[tuple[str, int, str]]:
    """(part, tokens, how) of one text: ``whole``, ``blocks`` (each under the text's headings) where all fit, else ``hard``."""
    count = lambda x: sum(1 for _ in _TOKEN.finditer(x))
    n = count(text)
    if n <= limit:
        return [(text, n, "whole")]
    heads, lines = blocks_of(text, is_heading)
    fixed, costs = sum(map(count, heads)), [count(x) for x in lines]
    parts = packed(costs, limit, fixed)
    sums = np.bincount(parts, weights=costs).astype(int) + fixed
    if len(sums) > 1 and sums.max() <= limit:
        return [("\n".join([*heads, *(x for x, p in zip(lines, parts, strict=True) if p == k)]), int(m), "blocks") for k, m in enumerate(sums)]
    return [(text[a:b], m, "hard") for a, b, m in hard_parts(text, limit)]


def _split(docs: DataFrame, cut: Callable[[str], list[tuple[str, int, str]]], key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                found = [cut(body or "") for body in piece.column(1).to_pylist()]
                counts = np.array([len(x) for x in found], np.int64)
                number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                columns = [[p[i] for x in found for p in x] for i in range(3)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts))), pa.array(number), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[0], pa.string())], names=["key", "part", "n_tokens", "how", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(rows, run, f"key {kind}, part long, n_tokens long, how string, text string").withColumnsRenamed({"key": key, "text": text})


def limited(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", heading: str = r"^#") -> DataFrame:
    """(key, part, n_tokens, how, text) of every row: no part has more than ``limit`` tokens, and parts are numbered from 0.

    A text within the limit stays as it is. Others are packed by lines, under the lines matching ``heading`` that begin them, which every part repeats; where a line, or the headings
    with one, are above the limit, the text is cut at tokens: the tokens of the parts are those of the text, in order. Null and empty texts are one empty part.
    """
    return _split(docs, lambda body: fitted(body, limit, lambda line: re.search(heading, line) is not None), key, text)


def cut(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same, always cut at tokens; a text without tokens has no part."""
    return _split(docs, lambda body: [(body[a:b], n, "hard") for a, b, n in hard_parts(body, limit)], key, text)


def balanced(costs: list[int], limit: int, fixed: int = 0, rows: int = TAIL_ROWS, tokens: int | None = None) -> list[int]:
    """The part of each table row: packed in order, then rows go from the last part but one to the last until that has ``rows`` rows and ``tokens`` tokens.

    Rows go only while the part before keeps ``rows`` and both stay within the limit; a tail that is still too short joins the part before where both fit, else it takes one more row.
    """
    tokens = max(TAIL_TOKENS, int(limit * TAIL_SHARE)) if tokens is None else tokens
    parts = packed(costs, limit, fixed)
    if not parts or parts[-1] == 0:
        return parts
    last = parts[-1]
    begin, tail = parts.index(last - 1), parts.index(last)
    before, after = fixed + sum(costs[begin:tail]), fixed + sum(costs[tail:])
    while tail - begin > rows and not (len(costs) - tail >= rows and after >= tokens):
        moved = costs[tail - 1]
        if before - moved > limit or after + moved > limit:
            break
        tail, before, after = tail - 1, before - moved, after + moved
    if len(costs) - tail < rows:
        if before + after - fixed <= limit:
            tail = len(costs)
        elif tail - begin > rows:
            tail -= 1
    return [last - 1 if begin <= i < tail else last if i >= tail else p for i, p in enumerate(parts)]


def rebalanced(rows: DataFrame, table: str, order: str, cost: Column, limit: int, fixed: int = 0, tokens: int | None = None) -> DataFrame:
    """``rows`` with part: every table's rows packed under a token limit with an even tail. ``fixed`` are the tokens of its repeated header.

    Only numbers of a table come together, not its rows' texts. Null costs count as 0. Rows of equal ``order`` of one table share the last one's part.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (table, order)}
    sizes = rows.groupBy(table).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(cost, F.lit(0)).cast("long").alias("cost")))).alias("rows"))
    numbers = sizes.select(F.col(table).alias("table"), F.transform("rows", lambda r: r["at"]).alias("at"), F.transform("rows", lambda r: r["cost"]).alias("cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [balanced(x, limit, fixed, tokens=tokens) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["table", "at", "part"])

    found = map_batches(numbers, run, f"table {kinds[table]}, at array<{kinds[order]}>, part array<long>")
    flat = found.select("table", F.explode(F.arrays_zip("at", "part")).alias("x")).groupBy("table", F.col("x.at").alias("at")).agg(F.max("x.part").alias("part"))
    return rows.join(flat, rows[table].eqNullSafe(flat["table"]) & rows[order].eqNullSafe(flat["at"])).drop("table", "at")
