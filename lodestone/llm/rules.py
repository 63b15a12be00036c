"""Quality rules as a short-circuit cascade, in built-in expressions only.

A rule is a boolean expression that rejects. Its cost (time over a sample, above that of an empty rule, features that it
reads included) and selectivity are measured on a bounded sample, and rules are tried in order of rejections per cost;
a row that one rule rejects is not shown to the next. The verdict is their disjunction, so the order
changes the work and never the result. The base counts are part of the result and so are computed for every row; what the
cascade spares are the capitals, digits and stop words.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected rows on which costs and selectivities are measured.
SAMPLE_ROWS = 400
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Very common words of four languages.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with au de des dans du elle en et est la le les par pas pour que qui sur un une auf das dem den der die ein eine für ist mit nicht sich und von zu al con del el es las lo los para por se su una y".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the row has twice or more."""

    def repeated(windows: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(windows, i)["gram"] == x["gram"], F.lit(False))
        return F.array_sort(F.transform(F.filter(windows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def of(w: Column) -> Column:
        gram = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("gram"), i.alias("at"))
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(let(windows, repeated), covered))

    return let(words, of).cast("long")


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns that rules read: body, n_words and the base counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("body", body).withColumn("words", words_of(F.col("body")))
    lines = F.filter(F.split("body", "\n"), lambda x: without(x, SPACES) != "")
    length = F.char_length("body")
    return (
        split.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.char_length(without(F.col("body"), SPACES)).cast("long"))
        .withColumn("n_symbols", (length - F.char_length(without(F.col("body"), SYMBOLS))).cast("long"))
        .withColumn("line_counts", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), duplicate_lines(x).alias("again"))))
        .withColumn("n_lines", F.col("line_counts")["lines"])
        .withColumn("n_dup_lines", F.col("line_counts")["again"])
        .withColumn("n_repeat_words", repeat_words(F.col("words")))
        .drop("line_counts")
    )


#: The contract's base, rejecting.
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def standard_rules() -> dict[str, Column]:
    """Name to rejecting expression over ``features``; thresholds are whole-number ratios."""
    n, body = F.col("n_words"), F.col("body")
    capitals = F.char_length(body) - F.char_length(without(body, CAPITALS))
    stops = F.size(F.array_intersect(F.transform("words", lambda w: F.lower(w)), F.array(*map(F.lit, STOP_WORDS))))
    digits = F.char_length(body) - F.char_length(without(body, "0123456789"))
    return {
        "few_words": n < 50,
        "repeated_windows": F.col("n_repeat_words") * 100 > n * 50,
        "symbols": F.col("n_symbols") * 10 > n,
        "duplicate_lines": F.col("n_dup_lines") * 2 > F.col("n_lines"),
        "short_words": F.col("word_chars") < n * 2,
        "long_words": F.col("word_chars") > n * 15,
        "capitals": capitals * 2 > F.col("word_chars"),
        "digits": digits * 2 > F.col("word_chars"),
        "stop_words": stops < 2,
    }


def calibrate(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names in order of rejections per second on a sample of at most ``sample_rows`` rows (ties: by name).

    ``docs`` has a column text. The sample is drawn from all partitions and all lengths, and stays on the executors;
    features are computed anew for each rule, so a rule pays for those that it reads. The sample only orders the work.
    An empty table is measured as well: all rules then have the same worth.
    """
    total = docs.count()
    drawn = docs.select("text").sample(min(1.0, sample_rows / max(1, total)), seed=42).repartition(4).cache()
    try:
        n = drawn.count()
        sample = features(drawn)

        def seconds(rule: Column) -> tuple[float, int]:
            best, hits = float("inf"), 0
            for _ in range(2):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(rule)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        floor = seconds(F.lit(False))[0]
        worth = {}
        for name, rule in rules.items():
            cost, hits = seconds(rule)
            worth[name] = (hits / n if n else 0.0) / max(cost - floor, 1e-4)
    finally:
        drawn.unpersist()
    return sorted(rules, key=lambda name: (-worth[name], name))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The name of the first rule in ``order`` that rejects, else null; later rules are not evaluated."""
    first, *rest = order
    out = F.when(rules[first], F.lit(first))
    for name in rest:
        out = out.when(rules[name], F.lit(name))
    return out


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, order: list[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, the base counts, base_failed and kept.

    Null and empty texts have no words and fail the base. Rows are independent, so repeated rows and null keys are
    judged like any other; other columns are ignored. ``order`` fixes the cascade and skips the sample.
    """
    rules = standard_rules() if rules is None else rules
    texts = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    order = calibrate(texts, rules) if order is None else order
    rows = features(texts)
    failed = F.expr(BASE)
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & cascade(rules, order).isNull()).alias("kept"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The same verdict in DuckDB's SQL.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d
), g AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), c AS (
  SELECT doc_id, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS again FROM g
), r AS (
  SELECT doc_id, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS covered FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), n AS (
  SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM r GROUP BY doc_id
), f AS (
  SELECT d.doc_id, body, words, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN n ON d.doc_id = n.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines OR word_chars < n_words * 2 OR word_chars > n_words * 15
    OR length(regexp_replace(body, '[^A-Z]', '', 'g')) * 2 > word_chars OR length(regexp_replace(body, '[^0-9]', '', 'g')) * 2 > word_chars
    OR len(list_distinct(list_intersect(list_transform(words, lambda x: lower(x)), [{_STOPS}]))) < 2) AS kept
FROM b
"""
