"""Dense, sparse and keyword retrieval, fusion, boosts and reranking.

Each search takes one query and ranks all rows: a narrow scoring projection and a top-k, which
Spark keeps as k rows a task. Fused lists are at most a few times k long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import map_batches, stored

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_scores(points: DataFrame, query: Sequence[float], vector: str = "embedding", keep: Column | None = None) -> DataFrame:
    """``points`` with a cosine ``score`` against one query vector, after the payload filter."""
    rows = points if keep is None else points.filter(keep)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.transform(vector, lambda x: x.cast("double")), q))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    return scored.orderBy(*order).limit(k)


def top_per_group(scored: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group and their rank from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their rank from 1; only k rows reach the one task that numbers them."""
    first = top(rows, k, *order)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def run_lengths(tokens: Column) -> Column:
    """ARRAY<STRUCT<token, tf>> of an array of tokens, counted inside the row: sorted once, then cut where tokens change."""
    keep = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def of(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        count = lambda at: F.transform(at, lambda x, i: F.struct(F.get(w, x).alias("token"), (F.coalesce(F.get(at, i + 1), F.size(w)) - x).cast("long").alias("tf")))
        return F.when(F.size(w) == 0, F.array().cast("array<struct<token:string,tf:bigint>>")).otherwise(keep(starts, count))

    return keep(F.array_sort(F.coalesce(tokens, F.array().cast("array<string>"))), of)


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, tf) of every row, counted inside the row: no shuffle. Equal keys are separate rows."""
    return docs.select(key, F.explode(run_lengths(T.tokens(F.col(text)))).alias("c")).select(key, "c.token", "c.tf")


def _length(runs: Column) -> Column:
    return F.sqrt(F.aggregate(runs, F.lit(0.0), lambda acc, x: acc + (1 + F.log(x["tf"])) * (1 + F.log(x["tf"]))))


def _is(token: str) -> Callable[[Column], Column]:
    return lambda w: w == token


def sparse_weights(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, weight): 1 + ln tf, scaled to unit length by row; counted, scaled and exploded in the row."""
    rows = docs.select(key, run_lengths(T.tokens(F.col(text))).alias("runs"))
    rows = rows.select(key, "runs", _length(F.col("runs")).alias("length"))
    return rows.select(key, "length", F.explode("runs").alias("c")).select(key, "c.token", ((1 + F.log("c.tf")) / F.col("length")).alias("weight"))


def sparse_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): dot product of a query's unit weights with each row's, found in the row: only scored rows leave the scan."""
    import math

    mine = docs.sparkSession.range(1).select(T.tokens(F.lit(query)).alias("t")).first()["t"] or []
    tf = {t: mine.count(t) for t in dict.fromkeys(mine)}
    if not tf:
        return docs.select(key, F.lit(0.0).alias("score")).filter("false")
    norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in tf.values()))
    words = docs.select(key, T.tokens(F.col(text)).alias("words")).filter(F.arrays_overlap("words", F.array(*map(F.lit, tf))))
    hit = F.lit(0.0)
    for t, n in tf.items():
        count = F.size(F.filter("words", _is(t)))
        hit = hit + F.when(count > 0, 1 + F.log(count.cast("double"))).otherwise(0.0) * ((1 + math.log(n)) / norm)
    return words.select(key, (hit / _length(run_lengths(F.col("words")))).alias("score"))


def keyword_scores(docs: DataFrame, terms: Sequence[str], exact: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Rows that have every term, or any exact phrase: matched phrases, and score = term share of the words + 10 for each phrase."""
    words = T.tokens(F.col(text))
    rows = docs.withColumn("words", words)
    wanted = F.array(*(F.lit(t) for t in terms))
    all_terms = F.size(F.array_intersect(wanted, F.col("words"))) == F.size(F.array_distinct(wanted))
    phrases = F.filter(F.array(*(F.lit(p) for p in exact)), lambda p: F.contains(F.lower(F.col(text)), F.lower(p))) if exact else F.array().cast("array<string>")
    found = rows.withColumn("matched", phrases)
    share = F.size(F.filter("words", lambda w: w.isin(*terms))) / F.greatest(F.size("words"), F.lit(1))
    return found.filter(all_terms | (F.size("matched") > 0)).withColumn("n_exact", F.size("matched").cast("long")).withColumn("score", share + 10.0 * F.size("matched")).drop("words")


def whole_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", term_key: str = "item_id", text: str = "text", pattern: str = "[a-z0-9]+", head: int = 5) -> DataFrame:
    """(term_key, key) for each row whose words hold all words of a term in a row.

    A term's first words (at most ``head``, fewer where it is shorter) are joined with the rows' word sequences for
    candidates; the whole term is then looked up in the candidate's words. Terms without words match nothing,
    repeated terms count once and repeated rows each.
    """
    padded = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    words = T.tokens(F.col(text), pattern)
    wanted = terms.select(F.col(term_key).alias("term_key"), words.alias("w")).filter(F.size("w") > 0)
    wanted = wanted.select("term_key", padded(F.col("w")).alias("term"), F.array_join(F.slice("w", 1, head), " ").alias("gram"), F.least(F.size("w"), F.lit(head)).alias("n")).distinct()
    rows = docs.select(F.col(key).alias("row_key"), F.xxhash64(text).alias("hash"), words.alias("w"))
    sizes = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # at most ``head`` numbers
    empty = F.array().cast("array<string>")
    starts = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(empty)
    grams = F.array_distinct(F.concat(empty, *map(starts, sizes)))
    near = rows.select("row_key", "hash", F.explode(grams).alias("gram")).join(wanted, "gram").select("row_key", "hash", "term_key", "term").distinct()
    near = near.withColumnsRenamed({"row_key": "near_key", "hash": "near_hash"})
    same = F.col("row_key").eqNullSafe(F.col("near_key")) & (F.col("hash") == F.col("near_hash"))
    found = rows.join(near, same).filter(F.contains(padded(F.col("w")), F.col("term")))
    return found.select(F.col("term_key").alias(term_key), F.col("row_key").alias(key))


def fuse(left: DataFrame, right: DataFrame, key: str, weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two (key, rank) lists: key, fused and source flags."""
    a, b = left.select(F.col(key), F.col("rank").alias("left_rank")), right.select(F.col(key), F.col("rank").alias("right_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c)), F.lit(0.0))
    flags = F.concat_ws("+", F.when(F.col("left_rank").isNotNull(), F.lit("vector")), F.when(F.col("right_rank").isNotNull(), F.lit("keyword")))
    return a.join(b, key, "full_outer").select(key, (part("left_rank", weights[0]) + part("right_rank", weights[1])).alias("fused"), flags.alias("flags"))


def boosts(content: Column, query_tokens: Sequence[str], codes: Sequence[str], shown: Column | None = None) -> Column:
    """Additive boosts: 50 where a code occurs, 8 by the share of query tokens in the content (or in ``shown``), less 0.02 where codes are asked for and missed."""
    share = T.coverage(F.array(*(F.lit(t) for t in query_tokens)), T.tokens(content if shown is None else shown)) if query_tokens else F.lit(0.0)
    hit = F.lit(False)
    for code in codes:
        hit = hit | F.contains(F.lower(content), F.lit(code.lower()))
    return 8.0 * share + (F.when(hit, 50.0).otherwise(-0.02) if codes else F.lit(0.0))


def overlap_score(query_tokens: Sequence[str], content: Column) -> Column:
    """The share of a query's distinct content tokens that the content has."""
    return T.coverage(F.array(*(F.lit(t) for t in query_tokens)), T.content_tokens(content)) if query_tokens else F.lit(0.0)


def hydrate(ids: DataFrame, rows: DataFrame, key: str, position: str = "rank") -> DataFrame:
    """Full rows for an ordered id list; ids without a row are dropped and the order is kept."""
    return ids.join(rows, key).orderBy(position)


def within(rows: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is in the scope: None is no restriction, an empty scope gives nothing."""
    return rows if scope is None else rows.join(scope.select(key).distinct(), key, "left_semi")


def excluding(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def overlap_rerank(query: str, content: Column) -> Column:
    """The share of a query's distinct words that the content has; words are runs of letters, digits and underscores, in lower case."""
    import re

    wanted = list(dict.fromkeys(w.lower() for w in re.findall(r"\w+", query)))
    have = F.regexp_extract_all(F.lower(content), F.lit(r"(?U)\w+"), F.lit(0))
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), have)) / len(wanted) if wanted else F.lit(0.0)


def fuse_channels(channels: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(key, fused, flags) of any number of (key, rank) lists: the sum of weight / (k + rank), and the channels that have the key, in order."""
    parts = None
    for number, (name, ranked_rows) in enumerate(channels.items()):
        part = ranked_rows.select(F.col(key), (F.lit((weights or {}).get(name, 1.0)) / (F.lit(k) + F.col("rank"))).alias("part"), F.struct(F.lit(number).alias("at"), F.lit(name).alias("name")).alias("flag"))
        parts = part if parts is None else parts.unionByName(part)
    summed = parts.groupBy(key).agg(F.sum("part").alias("fused"), F.array_sort(F.collect_set("flag")).alias("flags"))
    return summed.select(key, "fused", F.array_join(F.transform("flags", lambda f: f["name"]), "+").alias("flags"))


def degraded(vector: Callable[[], DataFrame], keyword: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """Fusion of a vector channel, given as a function that may fail, with a keyword channel; keyword alone, and True, where it fails.

    The channel's list, k rows of (key, rank), is run here and kept in the driver: a store that is lost or a task that fails shows only then.
    """
    try:
        ranked_rows = vector()
        schema = ranked_rows.select(key, "rank").schema
        found = ranked_rows.select(key, "rank").collect()
    except (PySparkException, Py4JError, OSError, RuntimeError):
        return fuse_channels({"keyword": keyword}, key), True
    return fuse_channels({"vector": keyword.sparkSession.createDataFrame(found, schema), "keyword": keyword}, key), False


def _packed(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Stored (block, keys, vectors) of rows with a vector, ``block`` rows or fewer each, packed where they stand."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c.take(pa.array(range(part.num_rows)))) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *lists], names=["block", "keys", "vectors"])
                number += 1

    plain = rows.filter(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>"))
    return stored(map_batches(plain, run, f"block long, keys array<{kind}>, vectors array<array<double>>"))


def top_of_set(points: DataFrame, queries: DataFrame, k: int, key: str, vector: str, block: int = 1024, group: str | None = None) -> DataFrame:
    """(query, key, score, rank): for every query the ``k`` points of greatest cosine, rounded to six places, ties by key.

    A set of queries against all points, in blocks: every block of queries is sent once to each part of the points, joined by the part's
    number, and meets a block of points as one matrix product that keeps ``k`` a query, so what is shuffled besides is k rows for each query and block.
    Null and zero vectors have no score and are left out; all have to be of one length. With ``group``, a column of the points, the
    first k of each of its values (null is one) are found.
    """
    kind = points.schema[key].dataType.simpleString()
    parted = [group] if group else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (names, unit), (asked, lines) = (_units(batch.column(a)[row].values, batch.column(b)[row].values) for a, b in (("keys", "vectors"), ("q_keys", "q_vectors")))
                if not len(unit) or not len(lines):
                    continue
                found = np.round(lines @ unit.T, 6)
                ranks = np.argsort(pc.sort_indices(names).to_numpy(), kind="stable")
                best = np.stack([np.lexsort((ranks, -line))[:k] for line in found])
                columns = [asked.take(pa.array(np.repeat(np.arange(len(lines)), best.shape[1]))), names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(found, best, 1).ravel())]
                extra = [pa.array([batch.column("part")[row].as_py()] * best.size, batch.schema.field("part").type)] if group else []
                yield pa.RecordBatch.from_arrays([*columns, *extra], names=["query", key, "score", *parted])

    held = _packed(points, key, vector, block) if group is None else _packed_by(points, group, key, vector, block)
    parts = max(1, held.count() // 16)
    asked = _packed(queries, key, vector, block).select(F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("share"))
    pairs = asked.join(held.withColumn("share", F.pmod("block", F.lit(parts)).cast("int")).hint("merge"), "share")
    extra = f", {group} {points.schema[group].dataType.simpleString()}" if group else ""
    best = map_batches(pairs, score, f"query {kind}, {key} {kind}, score double{extra}")
    rank = F.row_number().over(Window.partitionBy("query", *parted).orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _packed_by(points: DataFrame, group: str, key: str, vector: str, block: int) -> DataFrame:
    """Like ``_packed``, with every block of one value of ``group``, as ``part``; a batch's rows are packed value by value."""
    kind, value = points.schema[key].dataType.simpleString(), points.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            codes = batch.column(2).dictionary_encode(null_encoding="encode")
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            ends = np.cumsum(np.bincount(codes.indices.to_numpy(), minlength=len(codes.dictionary)))
            for own, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
                for at in range(a, b, block):
                    mine = pa.array(order[at : min(at + block, b)])
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), batch.column(i).take(mine)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, codes.dictionary.slice(own, 1)], names=["block", "keys", "vectors", "part"])
                    number += 1

    plain = points.filter(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>"), F.col(group))
    return stored(map_batches(plain, run, f"block long, keys array<{kind}>, vectors array<array<double>>, part {value}"))


def _units(keys: pa.Array, vectors: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Keys and unit vectors of a block, without zero vectors."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    norm = np.sqrt((m * m).sum(axis=1))
    return keys.filter(pa.array(norm > 0)), m[norm > 0] / norm[norm > 0, None]
