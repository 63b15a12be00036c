"""Passes over the ordered records of documents: carried state, stale headings, heading leads, section paths.

A pass that walks through records with a state is a composition of each record's step: set the state, clear it, fill it if it is empty, or
keep it. Such steps compose to a step of the same kind, so a document is cut into segments: windows give every record's state within its
segment, one row a segment is scanned for the states that segments begin with, and an equality join brings those back. A document of very many
records is so dealt to many tasks, and none holds more of it than a segment at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a segment.
SEGMENT = 4096


@dataclass
class Step:
    """What a record does with a state: ``put`` sets ``value`` whatever there was, ``clear`` empties it, ``fill`` sets it if it is empty; else it stays."""

    value: Column
    put: Column | None = None
    clear: Column | None = None
    fill: Column | None = None


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__{k}"]) for k in keys))


def _local(rows: DataFrame, keys: Sequence[str], order: str, steps: dict[str, Step]) -> DataFrame:
    """``rows`` with, by state, __hard (the last value put or cleared since the group began, in an array; null if none) and __fill (the first fill since)."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    no = F.lit(False)
    given = {}
    for name, s in steps.items():
        yes = lambda c: no if c is None else F.coalesce(c, no)
        given[f"__{name}_hard"] = F.when(yes(s.put), F.array(s.value)).when(yes(s.clear), F.array(F.when(no, s.value)))
        given[f"__{name}_fill"] = F.when(yes(s.fill), s.value)
    rows = rows.withColumns(given)
    rows = rows.withColumns({f"__{n}_run": F.count(f"__{n}_hard").over(upto) for n in steps} | {f"__{n}_last": F.last(f"__{n}_hard", ignorenulls=True).over(upto) for n in steps})
    for n, s in steps.items():
        if s.fill is not None:
            since = Window.partitionBy(*keys, f"__{n}_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn(f"__{n}_fill", F.first(f"__{n}_fill", ignorenulls=True).over(since))
    return rows.withColumns({f"__{n}_hard": F.col(f"__{n}_last") for n in steps}).drop(*(f"__{n}_{x}" for n in steps for x in ("run", "last")))


def _after(name: str, entry: Column | None) -> Column:
    """A record's state: from the last value put or cleared, else from the ``entry``, then from the first fill."""
    hard = F.col(f"__{name}_hard")
    base = F.when(hard.isNotNull(), F.get(hard, F.lit(0)))
    return F.coalesce(base if entry is None else base.when(hard.isNull(), entry), F.col(f"__{name}_fill"))


def carried(rows: DataFrame, keys: Sequence[str], order: str, steps: dict[str, Step], segment: int = SEGMENT) -> DataFrame:
    """``rows`` with, for each state, its value before a record (``<state>_before``) and after it (``<state>_after``).

    Records of equal ``keys`` (null is a value) are one document, in the order of the number ``order``, which should be unique in it; ties come in
    any order. A state begins empty. Columns whose names begin with two underscores are not for callers.
    """
    own = [*keys, "__segment"]
    local = _local(rows.withColumn("__segment", F.floor(F.col(order) / segment)), own, order, steps)
    # The step of a whole segment is that of its last record.
    parts = [F.max_by(F.struct(F.col(f"__{n}_hard").alias("hard"), F.col(f"__{n}_fill").alias("fill")), F.col(order)).alias(n) for n in steps]
    ends = local.groupBy(*own).agg(*parts)
    # A segment that ends empty after a hard step clears; one that ends with a value after it puts; else it fills or keeps.
    value = {n: F.when(F.col(f"{n}.hard").isNotNull(), F.coalesce(F.get(F.col(f"{n}.hard"), F.lit(0)), F.col(f"{n}.fill"))).otherwise(F.col(f"{n}.fill")) for n in steps}
    whole = {n: Step(value[n], F.col(f"{n}.hard").isNotNull() & value[n].isNotNull(), F.col(f"{n}.hard").isNotNull() & value[n].isNull(), F.col(f"{n}.hard").isNull() & F.col(f"{n}.fill").isNotNull()) for n in steps}
    scanned = _local(ends, keys, "__segment", whole)
    before = Window.partitionBy(*keys).orderBy("__segment")
    entries = scanned.select(*(F.col(k).alias(f"__{k}") for k in own), *(F.lag(_after(n, None)).over(before).alias(f"__{n}_entry") for n in steps))
    joined = local.join(entries, _same(local, entries, own), "left").drop(*(f"__{k}" for k in own))
    now = joined.withColumns({f"{n}_after": _after(n, F.col(f"__{n}_entry")) for n in steps})
    inner = Window.partitionBy(*own).orderBy(order)
    first = F.row_number().over(inner) == 1
    now = now.withColumns({f"{n}_before": F.when(first, F.col(f"__{n}_entry")).otherwise(F.lag(f"{n}_after").over(inner)) for n in steps})
    return now.select(*rows.columns, *(f"{n}_{x}" for n in steps for x in ("before", "after")))


def repaired_headings(rows: DataFrame, keys: Sequence[str], order: str, heading: Column, row_number: Column, is_object: Column, named: Column | None = None, resets: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with current (the table that a record belongs to), heading (after repair) and repair.

    The table is carried from record to record. ``named``, a table's own name, sets it, and so does an object ``heading``; one over rows that go on
    (``row_number`` above 1) does so only where no table is open. ``resets`` closes it. ``repair`` is ``replaced`` where an object heading differs, but for
    case, from the open table that its rows go on, or from the table's own name; ``prefixed`` where a record of rows without a heading gets the open table's;
    else null. Null headings are none.
    """
    rows = rows.withColumns({"__heading": heading, "__named": F.lit(None).cast("string") if named is None else named, "__object": F.coalesce(is_object & heading.isNotNull(), F.lit(False)), "__n": row_number})
    is_named = F.col("__named").isNotNull()
    goes_on = F.coalesce(F.col("__n") > 1, F.lit(False))
    closes = ~is_named & ~F.col("__object") & (F.lit(False) if resets is None else F.coalesce(resets, F.lit(False)))
    steps = {"table": Step(F.coalesce("__named", "__heading"), is_named | F.col("__object") & ~goes_on, closes, ~is_named & F.col("__object") & goes_on)}
    found = carried(rows, keys, order, steps, segment)
    other = lambda a, b: F.lower(a) != F.lower(b)
    open_ = F.col("table_before")
    stale = F.when(is_named, F.col("__object") & other(F.col("__heading"), F.col("__named"))).otherwise(F.col("__object") & goes_on & open_.isNotNull() & other(F.col("__heading"), open_))
    bare = ~is_named & F.col("__heading").isNull() & F.col("__n").isNotNull() & open_.isNotNull()
    repair = F.when(stale, F.lit("replaced")).when(bare & ~F.coalesce(closes, F.lit(False)), F.lit("prefixed"))
    fixed = F.when(repair.isNotNull(), F.col("table_after")).otherwise(F.col("__heading"))
    return found.select(*(c for c in rows.columns if not c.startswith("__")), F.col("table_after").alias("current"), fixed.alias("heading"), repair.alias("repair"))


def leads_forward(rows: DataFrame, keys: Sequence[str], order: str, text: str, is_lead: Column, page: Column, heading: Column, is_object: Column, segment: int = SEGMENT) -> DataFrame:
    """(keys, order, text, merged_from): a record that is only a heading or a lead goes into the record after it, on the same page or the next.

    Records have to be numbered without gaps. A record that took one in is not itself taken on, so of a row of leads every second one is; the next record's first line goes
    where its heading equals the lead's, but for case and white space, or both are objects. The merged record has the number of the later one, and ``merged_from`` that of the lead.
    """
    flags = rows.select(*keys, F.col(order), F.coalesce(is_lead, F.lit(False)).alias("__lead"), page.alias("__page"))
    # The page of the record after, by an equality join on its number: no window over a whole document. No text is moved yet.
    after = flags.select(*(F.col(k).alias(f"__{k}") for k in keys), (F.col(order) - 1).alias(f"__{order}"), F.col("__page").alias("__next"))
    both = flags.join(after, _same(flags, after, [*keys, order]), "left").drop(*(f"__{k}" for k in (*keys, order)))
    both = both.select(*keys, order, (F.col("__lead") & F.coalesce((F.col("__next") - F.col("__page")).between(0, 1), F.lit(False))).alias("__goes"))
    # In a row of leads the first goes on, the second has taken it in, and so on: parity since the last record that stays.
    walked = carried(both, keys, order, {"stays": Step(F.col(order), put=~F.col("__goes"))}, segment)
    merged = F.col("__goes") & ((F.col(order) - F.coalesce("stays_before", F.lit(-1))) % 2 == 1)
    gone = walked.filter(merged).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(order).alias(f"__{order}"), F.lit(True).alias("__gone"))
    whole = rows.select(*keys, order, F.col(text).alias("__text"), heading.alias("__heading"), F.coalesce(is_object, F.lit(False)).alias("__object"))
    placed = whole.join(gone, _same(whole, gone, [*keys, order]), "left").drop(*(f"__{k}" for k in (*keys, order)))
    target = F.when(F.col("__gone"), F.col(order) + 1).otherwise(F.col(order))
    # One or two records come together.
    pairs = placed.groupBy(*keys, target.alias(order)).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "__text", "__heading", "__object"))).alias("__parts"))
    first, second = F.get("__parts", F.lit(0)), F.get("__parts", F.lit(1))
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    drops = (clean(first["__heading"]) == clean(second["__heading"])) | first["__object"] & second["__object"]
    rest = F.when(F.coalesce(drops, F.lit(False)), F.regexp_replace(second["__text"], r"\A\s*[^\n]*(\n|\z)", "")).otherwise(second["__text"])
    two = F.size("__parts") == 2
    return pairs.select(*keys, order, F.when(two, F.concat_ws("\n", first["__text"], F.when(rest != "", rest))).otherwise(first["__text"]).alias(text), F.when(two, first["at"]).alias("merged_from"))


def section_paths(rows: DataFrame, keys: Sequence[str], order: str, level: Column, title: Column, levels: int = 6, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with path (the titles above a record and its own, outermost first) and parent (the latest earlier title of a lower level).

    ``level`` is 1 to ``levels`` for a heading and null for other records, whose path is that of the headings above and whose parent is the last of it. A heading
    ends all sections of its own and deeper levels. All levels are carried in one pass.
    """
    rows = rows.withColumns({"__level": level, "__title": title})
    steps = {f"level{n}": Step(F.col("__title"), put=F.col("__level") == n, clear=F.col("__level") < n) for n in range(1, levels + 1)}
    found = carried(rows, keys, order, steps, segment)
    after = F.array_compact(F.array(*(F.col(f"level{n}_after") for n in range(1, levels + 1))))
    above = F.array_compact(F.array(*(F.when(F.col("__level").isNull() | (F.lit(n) < F.col("__level")), F.col(f"level{n}_before")) for n in range(1, levels + 1))))
    return found.select(*(c for c in rows.columns if not c.startswith("__")), after.alias("path"), F.try_element_at(above, F.lit(-1)).alias("parent"))
