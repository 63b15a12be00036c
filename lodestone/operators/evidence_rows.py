"""Structured rows scored against a question, field by field."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.shared import map_batches, stored

#: The parts of a field's score, the worth of exact values of three tokens or more, of shorter ones and of a question within a value, of the raw text's share, and the least score.
COVERAGE, RECALL, COUNT = 0.45, 0.25, 0.3
LONG_EXACT, SHORT_EXACT, WITHIN, RAW = 2.5, 0.5, 0.25, 0.2
LEAST = 0.25
#: Distinct contents, and distinct questions, that meet at once, and the least pairs of common columns and block that tasks are dealt.
BLOCK, PAIRS = 1024, 64


def _tokens(text: Column) -> Column:
    return F.array_distinct(T.tokens(T.fold(text, keep_stroke=False), "[a-z0-9]+"))


def _common(rows: DataFrame, questions: DataFrame) -> list[str]:
    if not (on := [c for c in rows.columns if c in questions.columns]):
        raise ValueError("rows and questions meet by a common column")
    return on


def _used(fields: str, weights: Mapping[str, float], other: float) -> Column:
    """ARRAY<STRUCT<name, value, weight>> of the fields with a weight, by name."""
    worth = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map().cast("map<string,double>")
    plain = F.transform(F.sort_array(F.map_entries(fields)), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("value"), F.coalesce(F.try_element_at(worth, e["key"]), F.lit(float(other))).alias("weight")))
    return F.filter(plain, lambda e: e["weight"] > 0)


def _counted(used: Column) -> Column:
    """The same, folded: those that count."""
    used = F.filter(F.transform(used, lambda e: e.withField("value", T.fold(e["value"], keep_stroke=False))), lambda e: e["value"] != "")
    return F.filter(used, lambda e, i: ~F.exists(F.slice(used, 1, i), lambda p: p["value"] == e["value"]))


def _with_tokens(fields: str) -> Column:
    return F.transform(fields, lambda e: e.withField("tokens", F.array_distinct(F.regexp_extract_all(e["value"], F.lit("[a-z0-9]+"), F.lit(0)))))


def row_scores(rows: DataFrame, questions: DataFrame, fields: str, raw: str, question: str, weights: Mapping[str, float], other: float = 1.0) -> DataFrame:
    """``rows`` joined with ``questions`` on their common columns, with score and matched (the names of the fields that add to it).

    ``fields`` is a MAP of names to texts, a field's weight is that of its name, else ``other``; of fields with one value, the first by name counts, and weights of 0 or less none do. A value adds weight x (0.45 of
    its tokens that are the question's + 0.25 of the question's that are its + 0.3 for each), and 2.5 or 0.5 x weight if the question holds it whole, 0.25 if it holds the question. The raw text's share of the question adds 0.2. All
    are compared without marks and case. Questions and rows without tokens score 0.
    """
    both = rows.join(questions, _common(rows, questions)).withColumns({"__q": T.fold(F.coalesce(question, F.lit("")), keep_stroke=False), "__fields": _counted(_used(fields, weights, other))})
    both = both.withColumns({"__asked": _tokens(F.col("__q")), "__fields": _with_tokens("__fields")})
    asked = F.greatest(F.size("__asked"), F.lit(1))

    def part(e: Column) -> Column:
        n = F.size(F.array_intersect("__asked", e["tokens"])).cast("double")
        base = n / F.greatest(F.size(e["tokens"]), F.lit(1)) * COVERAGE + n / asked * RECALL + n * COUNT
        exact = F.when(F.contains(F.col("__q"), e["value"]), F.when(F.size(e["tokens"]) >= 3, LONG_EXACT).otherwise(SHORT_EXACT)).when((F.col("__q") != "") & F.contains(e["value"], F.col("__q")), WITHIN).otherwise(0.0)
        return F.when(n > 0, e["weight"] * (base + exact)).otherwise(0.0)

    parts = F.transform("__fields", lambda e: F.struct(e["name"].alias("name"), part(e).alias("part")))
    shared = F.size(F.array_intersect("__asked", _tokens(F.coalesce(raw, F.lit(""))))).cast("double")
    scored = both.withColumn("__parts", parts)
    total = F.aggregate("__parts", F.lit(0.0), lambda s, p: s + p["part"]) + RAW * shared / asked
    named = F.transform(F.filter("__parts", lambda p: p["part"] > 0), lambda p: p["name"])
    return scored.withColumns({"score": F.when(F.size("__asked") > 0, total).otherwise(0.0), "matched": F.when(F.size("__asked") > 0, named).otherwise(F.array().cast("array<string>"))}).drop("__q", "__fields", "__asked", "__parts")


def evidence(scored: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of at least ``least``, best first where they are ordered by score (ties keep their own order)."""
    return scored.filter(F.col("score") >= least)


class _Contents:
    """A block of distinct contents: their distinct values, the fields in order, and what holds a token."""

    def __init__(self, held: pa.StructArray):
        fields, raw, keys = held.flatten()
        values: dict[str, int] = {}
        self.fields, places, by_token, by_raw, sizes = [], [], defaultdict(list), defaultdict(list), []
        for c, (mine, words) in enumerate(zip(fields.to_pylist(), raw.to_pylist(), strict=True)):
            self.fields.append([(e["name"], values.setdefault(e["value"], len(values)), e["weight"]) for e in mine])
            for j, (e, (_, v, weight)) in enumerate(zip(mine, self.fields[-1], strict=True)):
                if v == len(sizes):
                    sizes.append(max(len(e["tokens"]), 1))
                    for t in e["tokens"]:
                        by_token[t].append(v)
                if j == len(places):
                    places.append([])
                places[j].append((c, v, weight))
            for t in words:
                by_raw[t].append(c)
        self.values, self.sizes = list(values), np.array(sizes, float)
        self.places = [tuple(np.array(x) for x in zip(*p, strict=True)) for p in places]
        self.by_token, self.by_raw = ({t: np.array(x) for t, x in d.items()} for d in (by_token, by_raw))
        self.keys, n = keys.flatten().field("key"), keys.value_lengths().to_numpy(zero_copy_only=False)
        self.ends, self.ranks = np.cumsum(n), np.argsort(pc.sort_indices(self.keys, null_placement="at_start").to_numpy(), kind="stable")
        self.starts = self.ends - n
        self.first = np.minimum.reduceat(self.ranks, self.starts)

    def scores(self, q: str, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The worth of every value, before weights, and the score of every content: ``row_scores``, in its order of additions."""
        n, asked, worth = self._shared(self.by_token, tokens, len(self.values)), max(len(tokens), 1), np.zeros(len(self.values))
        some = np.flatnonzero(n)
        exact = [(LONG_EXACT if self.sizes[v] >= 3 else SHORT_EXACT) if self.values[v] in q else WITHIN if q and q in self.values[v] else 0.0 for v in some]
        worth[some] = n[some] / self.sizes[some] * COVERAGE + n[some] / asked * RECALL + n[some] * COUNT + np.array(exact)
        score = np.zeros(len(self.fields))
        for c, v, weight in self.places:
            score[c] += weight * worth[v]
        return worth, score + RAW * self._shared(self.by_raw, tokens, len(score)) / asked

    @staticmethod
    def _shared(by: dict[str, np.ndarray], tokens: list[str], size: int) -> np.ndarray:
        met = [by[t] for t in tokens if t in by]
        return np.bincount(np.concatenate(met), minlength=size).astype(float) if met else np.zeros(size)

    def best(self, q: str, tokens: list[str], k: int, least: float) -> Iterator[tuple[int, float, list[str]]]:
        """(place of a key, score, matched) of the first ``k`` rows. A content that ``k`` others go before by score and first key has none of them."""
        worth, score = self.scores(q, tokens)
        found = np.flatnonzero(score >= least)
        score = np.floor(score * 1e6 + 0.5) / 1e6
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        found = found[np.lexsort((self.first[found], -score[found]))[:k]]
        n = self.ends[found] - self.starts[found]
        at, which = np.repeat(self.starts[found] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(found, n)
        order = np.lexsort((self.ranks[at], -score[which]))[:k]
        named = {c: [name for name, v, weight in self.fields[c] if weight * worth[v] > 0] for c in set(which[order].tolist())}
        for a, c in zip(at[order].tolist(), which[order].tolist(), strict=True):
            yield a, float(score[c]), named[c]


def best_rows(rows: DataFrame, questions: DataFrame, fields: str, raw: Column, question: Column, weights: Mapping[str, float], key: str, k: int, other: float = 1.0, least: float = LEAST) -> DataFrame:
    """The ``k`` best of ``row_scores`` for every question, of those of at least ``least``: the columns of ``questions`` with key, score (rounded to six places), matched and rank; ties by key.

    Rows of one content (common columns, fields with a weight, raw text) have one score, so each content keeps its first ``k`` keys and meets each distinct question once, in blocks
    joined by common columns and number; a pair of blocks gives ``k`` rows a question. What grows is distinct contents times distinct questions.
    """
    on = _common(rows, questions)
    kind = rows.schema[key].dataType.simpleString()
    part = F.struct(*on).alias("part")
    held = rows.dropna(subset=on).select(part, F.struct(_used(fields, weights, other).alias("fields"), F.coalesce(raw, F.lit("")).alias("raw")).alias("content"), F.col(key).alias("key"))
    first = F.row_number().over(Window.partitionBy("part", F.to_json("content")).orderBy("key"))  # text sorts faster than nested columns
    kept = stored(held.withColumn("n", first).filter(F.col("n") <= k).groupBy("part", "content").agg(F.collect_list(F.struct("key")).alias("keys")))
    sizes = kept.groupBy("part").count().agg(F.count("*").alias("parts"), F.max("count").alias("most")).first()
    shares = max(1, -(-(sizes["most"] or 0) // BLOCK), PAIRS // max(1, sizes["parts"]))
    tasks = min(1024, shares * max(1, sizes["parts"]))
    texts = kept.select("part", F.pmod(F.xxhash64("content"), F.lit(shares)).cast("int").alias("share"), _counted(F.col("content.fields")).alias("fields"), _tokens(F.col("content.raw")).alias("raw"), "keys")
    blocks = texts.groupBy("part", "share").agg(F.collect_list(F.struct(_with_tokens("fields").alias("fields"), "raw", "keys")).alias("held"))
    folded = questions.dropna(subset=on).withColumns({"part": part, "__q": T.fold(F.coalesce(question, F.lit("")), keep_stroke=False)})
    asks = stored(folded.select("part", F.col("__q").alias("q")).distinct())
    apart = F.pmod(F.xxhash64("q"), F.lit(max(1, asks.count() // BLOCK))).alias("block")
    asked = asks.groupBy("part", apart).agg(F.collect_list(F.struct("q", _tokens(F.col("q")).alias("tokens"))).alias("asked")).select("part", "asked", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = contents = None
        for batch in batches:
            for row in range(batch.num_rows):
                if now != (now := (batch.column("part")[row].as_py(), batch.column("share")[row].as_py())):
                    contents = _Contents(batch.column("held")[row].values)
                found = [(a["q"], *r) for a in batch.column("asked")[row].as_py() for r in contents.best(a["q"], a["tokens"], k, least)]
                if found:
                    q, at, score, matched = zip(*found, strict=True)
                    columns = [batch.column("part").take(pa.array([row] * len(q))), pa.array(q), contents.keys.take(pa.array(at)), pa.array(score), pa.array(matched, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "q", "key", "score", "matched"])

    # By number: the rows are few and small for what they cost, so their bytes must not set the tasks.
    pairs = asked.repartition(tasks, "part", "share").join(blocks.repartition(tasks, "part", "share").hint("merge"), ["part", "share"]).select("part", "share", "asked", "held")
    found = map_batches(pairs, run, f"part {pairs.schema['part'].dataType.simpleString()}, q string, key {kind}, score double, matched array<string>")
    rank = F.row_number().over(Window.partitionBy("part", "q").orderBy(F.desc("score"), "key"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnsRenamed({"q": "__q", "key": key})
    return folded.join(best, ["part", "__q"]).select(*questions.columns, key, "score", "matched", "rank")
