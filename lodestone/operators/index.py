"""A positional search index: postings clustered by term, and the searches that read no more than their terms' buckets.

A posting is a term's place list in one document, with what scores need of that document: its number of words and the
term's unit-length weight. Postings are written in folders by a hash of the term, sorted by term in every file, so that a search opens the
folders of its terms and skips row groups of others; a frequent term's postings are spread over several files of its
folder. Texts are tokenised once, when the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.shared import map_batches, shared_dir, state_of

#: Bytes of documents for each folder of postings, the fewest and most folders, and the files that one is dealt into.
BUCKET_BYTES, FOLDERS, SPLITS = 16 << 20, (8, 4096), 8
#: Words that a task gathers at once.
WORDS = 1 << 20
#: Terms that a filter names one by one; more of them are joined.
LITERALS = 1000
#: The worth of a cover without other words.
COVER = 0.1


def _gathered(keys: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    """Postings of some rows: equal words of a row are brought together, their places ascending."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    both = row * max(1, len(coded.dictionary)) + codes
    order = np.argsort(both, kind="stable")
    first = np.flatnonzero(np.diff(both[order], prepend=-1))
    tf = np.diff(np.append(first, len(order)))
    row, codes = row[order][first], codes[order][first]
    weight = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(sizes)))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes)), keys.take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), pa.array(weight / norm[row] if len(row) else weight), places], names=["term", "key", "n_words", "weight", "places"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, side="right")))
            yield _gathered(batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at))
            at = stop


def postings_of(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = T.WORD) -> DataFrame:
    """(term, key, n_words, weight, places) of every document and word: no shuffle. Null and empty texts have none.

    ``weight`` is 1 + ln of the term's count, scaled to unit length by document.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(T.tokens(F.col(text), pattern), F.array().cast("array<string>")).alias("words"))
    return map_batches(rows, _postings, f"term string, key {kind}, n_words int, weight double, places array<int>")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _bucket_of(term: str, buckets: int) -> int:
    """The same, of one term: Spark's hash of a string is XXH64 with seed 42, signed."""
    hashed = xxhash.xxh64_intdigest(term.encode(), 42)
    return (hashed - (hashed >> 63 << 64)) % buckets


@dataclass
class Index:
    """An index below ``where``; keys are ids, one row each."""

    spark: SparkSession
    where: str
    key: str
    kind: str
    pattern: str
    buckets: int

    # Build

    @classmethod
    def build(cls, docs: DataFrame, where: str | None = None, key: str = "doc_id", text: str = "text", pattern: str = T.WORD, buckets: int | None = None) -> Index:
        """Write the postings of ``docs`` and their vocabulary (term, bucket, number of documents)."""
        spark = docs.sparkSession
        held = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = buckets or min(max(held // BUCKET_BYTES, FOLDERS[0]), FOLDERS[1])
        index = cls(spark, where or shared_dir(spark), key, docs.schema[key].dataType.simpleString(), pattern, buckets)
        rows = postings_of(docs, key, text, pattern).withColumn("bucket", _bucket(F.col("term"), buckets))
        dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("key"), F.lit(SPLITS))).sortWithinPartitions("bucket", "term", "key")
        dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{index.where}/postings")
        index.all().groupBy("bucket", "term").agg(F.count("*").alias("n_docs")).write.mode("overwrite").parquet(f"{index.where}/vocabulary")
        return index

    def all(self) -> DataFrame:
        """Every posting."""
        return self.spark.read.schema(f"term string, key {self.kind}, n_words int, weight double, places array<int>, bucket int").parquet(f"{self.where}/postings")

    def vocabulary(self) -> DataFrame:
        return self.spark.read.schema("bucket int, term string, n_docs long").parquet(f"{self.where}/vocabulary")

    # Read

    def postings(self, terms: Sequence[str] | DataFrame) -> DataFrame:
        """The postings of ``terms``: a few named ones, or a table (bucket, term), whose buckets prune folders when the query runs."""
        if isinstance(terms, DataFrame):
            return self.all().join(terms.select("bucket", "term").distinct(), ["bucket", "term"])
        wanted = list(dict.fromkeys(terms))
        if not wanted:
            return self.all().filter("false")
        if len(wanted) > LITERALS:
            rows = self.spark.createDataFrame([(t,) for t in wanted], "term string")
            return self.postings(rows.withColumn("bucket", _bucket(F.col("term"), self.buckets)))
        return self.all().filter(F.col("bucket").isin(*{_bucket_of(t, self.buckets) for t in wanted}) & F.col("term").isin(*wanted))

    def words(self, text: str) -> list[str]:
        """The words of a query, as documents have them."""
        return self.spark.sql("SELECT :text AS text", args={"text": text}).select(T.tokens(F.col("text"), self.pattern).alias("w")).first()["w"] or []

    # Search

    def sparse_scores(self, query: str) -> DataFrame:
        """(key, score) of the documents with a word of the query: the dot product of unit-length weights."""
        mine = self.words(query)
        if not mine:
            return self.all().select(F.col("key").alias(self.key), F.lit(0.0).alias("score")).filter("false")
        tf = {t: 1 + float(np.log(mine.count(t))) for t in dict.fromkeys(mine)}
        norm = float(np.sqrt(sum(w * w for w in tf.values())))
        part = F.lit(0.0)
        for t, w in tf.items():
            part = F.when(F.col("term") == t, F.col("weight") * (w / norm)).otherwise(part)
        return self.postings(list(tf)).groupBy(F.col("key").alias(self.key)).agg(F.sum(part).alias("score"))

    def near_phrases(self, phrases: Sequence[str]) -> DataFrame:
        """(phrase, key) of the documents in which a phrase can stand: its words in a row, the first and last ones perhaps parts of words.

        Every document that contains the phrase is among them if its letters and digits are words of the index; a phrase without any is refused.
        """
        words, wanted = [self.words(p) for p in phrases], None
        for number, mine in enumerate(words):
            if not mine:
                raise ValueError(f"no words to search by in {phrases[number]!r}")
            for slot, w in enumerate(mine):
                first, last = slot == 0, slot == len(mine) - 1
                term, own = F.col("term"), F.lit(w)
                like = F.contains(term, own) if first and last else F.endswith(term, own) if first else F.startswith(term, own) if last else (F.col("bucket") == _bucket_of(w, self.buckets)) & (term == own)
                rows = self.vocabulary().filter(like).select("bucket", "term", F.lit(number).alias("phrase"), F.lit(slot).alias("slot"))
                wanted = rows if wanted is None else wanted.unionByName(rows)
        if wanted is None:
            return self.all().select(F.lit(0).alias("phrase"), "key").filter("false")
        few = wanted.limit(LITERALS + 1).collect()
        terms = [r["term"] for r in few]
        if len(few) <= LITERALS:
            wanted = F.broadcast(self.spark.createDataFrame(few, wanted.schema))
        rows = (self.postings(terms) if len(few) <= LITERALS else self.postings(wanted)).join(wanted.drop("bucket"), "term")
        at = F.explode("places")  # a phrase's place is that of its first word
        slots = rows.select("phrase", "key", "slot", at.alias("at")).groupBy("phrase", "key", (F.col("at") - F.col("slot")).alias("at")).agg(F.count_distinct("slot").alias("n"))
        sizes = F.array(*(F.lit(len(mine)) for mine in words))
        return slots.filter(F.col("n") == F.get(sizes, F.col("phrase"))).select("phrase", "key").distinct()

    def keyword_scores(self, docs: DataFrame, terms: Sequence[str], phrases: Sequence[str] = (), text: str = "text") -> DataFrame:
        """(key, n_exact, score) of the documents that have every term, or contain any phrase in either case.

        Score: the share of the document's words that are terms, plus 10 for each phrase. Only the texts of documents in which a phrase can
        stand are read from ``docs``.
        """
        wanted = list(dict.fromkeys(terms))
        hits = self.postings(wanted).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("places")).alias("hits"), F.first("n_words").alias("n_words"))
        exact = self.spark.createDataFrame([], f"key {docs.schema[self.key].dataType.simpleString()}, n_exact long")
        if phrases:
            near = self.near_phrases(phrases).select("key").distinct()
            few = [r["key"] for r in near.limit(LITERALS + 1).collect()]
            rows = docs.join(near.withColumnRenamed("key", self.key), self.key, "left_semi") if len(few) > LITERALS else docs.filter(F.col(self.key).isin(*few))
            held = [F.contains(F.lower(text), F.lit(p.lower())).cast("long") for p in phrases]
            exact = rows.select(F.col(self.key).alias("key"), sum(held[1:], held[0]).alias("n_exact")).filter("n_exact > 0")
        both = hits.join(exact, "key", "full_outer").filter((F.col("n") == len(wanted)) & F.lit(bool(wanted)) | F.col("n_exact").isNotNull())
        n_exact = F.coalesce("n_exact", F.lit(0).cast("long"))
        share = F.coalesce(F.col("hits") / F.greatest("n_words", F.lit(1)), F.lit(0.0))
        return both.select(F.col("key").alias(self.key), n_exact.alias("n_exact"), (share + 10.0 * n_exact).alias("score"))

    def _met(self, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(postings, pairs) of queries' terms (query, m, term, bucket), each term once: the terms' postings, and (query, key) of the documents with all ``m`` terms, found by counts alone."""
        named = [r["term"] for r in parts.select("term").distinct().limit(LITERALS + 1).collect()]
        rows = self.postings(named) if len(named) <= LITERALS else self.postings(parts.select("bucket", "term"))
        met = rows.select("term", "key").join(parts.drop("bucket"), "term").groupBy("query", "key").agg(F.count("*").alias("n"), F.first("m").alias("m")).filter("n = m").select("query", "key")
        return rows, met

    def phrase_counts(self, queries: DataFrame, name: str, text: str) -> DataFrame:
        """(name, key, n) of every document that has all words of a query in a row, and how often, for a table of queries; one without words finds nothing."""
        words = T.tokens(F.col(text), self.pattern)
        asked = queries.select(F.struct(F.col(name).alias("name"), F.xxhash64(text).alias("hash")).alias("query"), words.alias("words")).filter(F.size("words") > 0).distinct()
        slots = asked.select("query", F.size("words").alias("size"), F.size(F.array_distinct("words")).alias("m"), F.posexplode("words").alias("slot", "term"))
        rows, met = self._met(slots.select("query", "m", "term").distinct().withColumn("bucket", _bucket(F.col("term"), self.buckets)))
        places = rows.select("term", "key", "places").join(slots, "term").join(met, ["query", "key"]).select("query", "key", "size", "slot", F.explode("places").alias("at"))
        begun = places.groupBy("query", "key", (F.col("at") - F.col("slot")).alias("at")).agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("n = size")
        return begun.groupBy("query", "key").agg(F.count("*").alias("n")).select(F.col("query.name").alias(name), F.col("key").alias(self.key), "n")

    def cover_scores(self, queries: DataFrame, name: str, text: str) -> DataFrame:
        """(name, key, n_covers, score) of every document with all words of a query, for a table of queries.

        A cover is a stretch of the document that has every word of the query and no shorter stretch in it does; it is worth 0.1, divided by one
        more than its words that are no words of the query. A query without words finds nothing; repeated names are one query each by text.
        """
        own = F.array_distinct(T.tokens(F.col(text), self.pattern))
        asked = queries.select(F.struct(F.col(name).alias("name"), F.xxhash64(text).alias("hash")).alias("query"), own.alias("terms")).filter(F.size("terms") > 0).distinct()
        parts = asked.select("query", F.explode("terms").alias("term")).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        named = [r["term"] for r in parts.select("term").distinct().limit(LITERALS + 1).collect()]
        rows = self.postings(named) if len(named) <= LITERALS else self.postings(parts)
        # Documents with a query's rarest term are its candidates; each document's place lists are brought together once, for all queries.
        counted = parts.join(self.vocabulary(), ["bucket", "term"])
        rarest = counted.groupBy("query").agg(F.min(F.struct("n_docs", "term"))["term"].alias("term"))
        pairs = rows.select("term", "key").join(rarest, "term").select("query", "key")
        held = rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("held"))
        both = pairs.join(held, "key").join(asked, "query").filter(F.forall("terms", lambda t: F.map_contains_key("held", t)))
        lists = F.transform("terms", lambda t, i: F.struct(i.alias("t"), F.try_element_at("held", t).alias("places")))
        found = both.select("query", "key", lists.alias("lists"), F.size("terms").alias("m"))
        scored = found.select("query", "key", covers(F.col("lists"), F.col("m")).alias("c"))
        return scored.select(F.col("query.name").alias(name), F.col("key").alias(self.key), F.col("c.n").alias("n_covers"), F.col("c.score").alias("score"))


def covers(lists: Column, m: Column) -> Column:
    """STRUCT<n, score> of the minimal covers of ARRAY<STRUCT<t, places>>, the place lists of ``m`` terms numbered from 0.

    One pass over all places in order: the cover that ends here begins at the earliest of the terms' latest places, and is minimal if
    that beginning was not met before.
    """
    keep = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    every = F.array_sort(F.flatten(F.transform(lists, lambda x: F.transform(x["places"], lambda p: F.struct(p.alias("at"), x["t"].alias("t"))))))

    def scan(held: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            last = F.transform(s["last"], lambda x, t: F.when(t == F.get(held, i)["t"], i).otherwise(x))

            def ended(now: Column) -> Column:
                begin = F.array_min(now)
                other = F.get(held, i)["at"] - F.get(held, begin)["at"] - (i - begin)
                new = begin > s["begin"]
                return F.struct(now.alias("last"), F.greatest(begin, s["begin"]).alias("begin"), (s["n"] + new.cast("long")).alias("n"), (s["score"] + F.when(new, F.lit(COVER) / (1 + other)).otherwise(0.0)).alias("score"))

            return keep(last, ended)

        start = F.struct(F.array_repeat(F.lit(-1), m).alias("last"), F.lit(-1).alias("begin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"))
        return F.aggregate(F.sequence(F.lit(0), F.size(held) - 1), start, step, lambda s: F.struct(s["n"].alias("n"), s["score"].alias("score")))

    return keep(every, scan)


def best(scored: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


_built: dict[tuple, Index] = {}


def index_of(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = T.WORD) -> Index:
    """The index of a table of files, built once per application for each state of the files."""
    state = (docs.sparkSession.sparkContext.applicationId, key, text, pattern, state_of(docs))
    if state not in _built:
        _built[state] = Index.build(docs, key=key, text=text, pattern=pattern)
    return _built[state]
