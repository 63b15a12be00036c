"""Neighbours of found chunks, admitted one by one under one running budget."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import map_batches

#: Coverage neighbours of one found chunk that may go beyond the budget.
OVERRIDES = 2


def admitted(rows: Sequence[dict], budget: int, used: int, seen: Sequence, overrides: int = OVERRIDES) -> list[tuple]:
    """(id, used after) of the candidates that are let in, in order.

    A candidate that is in already is passed over. One of kind ``coverage`` that does not fit is passed over too, and later ones may still fit; up to ``overrides`` for each hit, counting all
    coverage let in for it, come in beyond the budget if they have a strong signal. One of another kind that does not fit ends the expansion.
    """
    held, out, hit, added = set(seen), [], None, 0
    for r in rows:
        if r["hit"] != hit:
            hit, added = r["hit"], 0
        if r["id"] in held:
            continue
        over = used + r["cost"] > budget
        if over and r["kind"] != "coverage":
            break
        if over and not (r["signal"] and added < overrides):
            continue
        held.add(r["id"])
        used += r["cost"]
        added += r["kind"] == "coverage"
        out.append((r["id"], used))
    return out


def expanded(hits: DataFrame, candidates: DataFrame, query: str, budget: int, overrides: int = OVERRIDES) -> DataFrame:
    """(query, id, citation, used) of what is added to every query's hits.

    ``hits`` has query, id, hit (its place) and cost; ``candidates`` query, hit, kind (``coverage``, ``table`` or ``article``), at, id, cost and signal. Hits are gone through in order; for each,
    its coverage, then its table's, then its article's neighbours by ``at``. Citations go on from the last hit's. Null costs are 0; a null query is one. A query's hits and their neighbours, numbers only, come together.
    """
    name = hits.schema[query].dataType.simpleString()
    kind = hits.schema["id"].dataType.simpleString()
    cost = F.coalesce(F.col("cost"), F.lit(0)).cast("long")
    begun = hits.groupBy(query).agg(F.sum(cost).alias("used"), F.max("hit").cast("long").alias("last"), F.collect_list("id").alias("seen"))
    order = F.when(F.col("kind") == "coverage", 0).when(F.col("kind") == "table", 1).otherwise(2)
    listed = F.array_sort(F.collect_list(F.struct("hit", order.alias("stage"), "at", "id", cost.alias("cost"), F.coalesce("signal", F.lit(False)).alias("signal"), "kind")))
    rows = candidates.groupBy(F.col(query).alias("__query")).agg(listed.alias("rows"))
    both = begun.join(rows, F.col(query).eqNullSafe(F.col("__query"))).select(F.col(query).alias("query"), "used", "last", "seen", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for q, used, last, seen, mine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(q, i, last + n, total) for n, (i, total) in enumerate(admitted(mine, budget, used, seen, overrides), 1)]
            types = (batch.schema.field(0).type, batch.schema.field(3).type.value_type, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, types, strict=True)], names=["query", "id", "citation", "used"])

    return map_batches(both, run, f"query {name}, id {kind}, citation long, used long").withColumnRenamed("query", query)
