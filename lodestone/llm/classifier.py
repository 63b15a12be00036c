"""Quality classifier from weak labels.

Two tasks, junk and toxicity, have overlapping heuristic labellers that vote to reject, to accept or abstain.
Expectation-maximisation over the counts of all vote patterns in the corpus (at most 3**labellers of
them) estimates each labeller's accuracy per class. The posterior labels of a bounded sample
train a hashed linear scorer for each task, and the scorers judge every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Words, blocks, row_of, ship, stored, text_bytes
from .rules import STOP_WORDS

#: Expected labelled rows of the training sample (half as many of all rows are added): the bound on what is fitted.
TRAIN_ROWS = 8_000
#: Bytes of features of the sample that reach the driver; a sample of longer texts is thinned by hash.
TRAIN_BYTES = 64 << 20
DIMENSIONS = 1 << 18
#: Rows that a feature is in, at least, to get a weight.
LEAST_ROWS = 8
#: Scores from which a row is rejected, and posteriors of its heuristics alone.
THRESHOLD, CERTAIN = 0.3, 0.99
#: Common English insults, one labeller's list each: names for people, what they are called, and waste and vermin. No word is in two lists.
PEOPLE = "asshole bastard bitch clown coward creep cretin degenerate dumbass fool freak idiot imbecile jerk loser moron swine wretch".split()
QUALITIES = "disgusting dumb ignorant moronic pathetic repulsive stupid ugly useless vile worthless".split()
WASTE = "garbage lowlife parasite pig scum scumbag shit trash vermin".split()
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
REJECT, ACCEPT, ABSTAIN = 1, 0, 2
#: The prior share of accepted rows on which a heuristic labeller votes to reject.
FALSE_ALARMS = 0.002
#: The accuracy that annotators are credited with; it is not estimated.
ANNOTATOR = 0.99


def _hashes(texts: list[str]) -> np.ndarray:
    words = Words(*text_bytes(pa.array(texts, pa.string())), _WORD)
    return np.sort(words.hashes())


_STOPS = _hashes(STOP_WORDS)
INSULTS = {"people": _hashes(PEOPLE), "qualities": _hashes(QUALITIES), "waste": _hashes(WASTE)}


def _among(values: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    return fixed[np.minimum(np.searchsorted(fixed, values), len(fixed) - 1)] == values


@dataclass
class Block:
    """What labellers and scorers read of a block of texts: statistics by row, and distinct (row, word) pairs."""

    rows: int
    pair_row: np.ndarray
    pair_word: np.ndarray
    stats: dict[str, np.ndarray] = field(default_factory=dict)


def read_block(data: np.ndarray, offsets: np.ndarray) -> Block:
    rows = len(offsets) - 1
    words = Words(LOWER[data], offsets, _WORD)
    hashes, row = words.hashes(), row_of(words.first)
    order = np.lexsort((hashes, row))
    pairs = hashes[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (row[1:] != row[:-1])
    block = Block(rows, row[new], pairs[new])
    n = words.counts()
    sums = np.zeros(len(data) + 1, np.int64)

    def chars(table: np.ndarray) -> np.ndarray:
        np.cumsum(table[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def of(low: int, high: int) -> np.ndarray:
        return np.isin(np.arange(256), np.arange(low, high + 1))

    per = lambda a, b: a / np.maximum(b, 1)
    letters = of(0x61, 0x7A) | of(0x41, 0x5A) | of(0x80, 0xFF)
    # A word after itself, the commonest kind of repetition.
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    by_row = lambda values: np.bincount(row, values, rows)
    block.stats = {
        "words": n,
        "symbols": per(chars(np.isin(np.arange(256), list(b"#*$%&|<>"))), n),
        "exclaimed": per(chars(np.isin(np.arange(256), list(b"!"))), n),
        "capitals": per(chars(of(0x41, 0x5A)), chars(letters)),
        "distinct": per(np.bincount(block.pair_row, minlength=rows), n),
        "again": per(by_row(again), n),
        "stops": per(by_row(_among(hashes, _STOPS).astype(float)), n),
        **{name: np.bincount(block.pair_row, _among(block.pair_word, words), rows) for name, words in INSULTS.items()},
    }
    return block


def _vote(reject: np.ndarray, accept: np.ndarray) -> np.ndarray:
    return np.where(reject, REJECT, np.where(accept, ACCEPT, ABSTAIN))


def junk_votes(block: Block) -> list[np.ndarray]:
    s = block.stats
    long = s["words"] >= 20
    return [
        _vote(s["symbols"] > 0.15, s["symbols"] < 0.05),
        _vote(long & (s["stops"] < 0.02), s["stops"] > 0.06),
        _vote(long & (s["again"] > 0.2), s["again"] < 0.05),
        _vote((s["words"] >= 50) & (s["distinct"] < 0.2), s["distinct"] > 0.4),
        _vote(long & (s["capitals"] > 0.5), s["capitals"] < 0.2),
        _vote(long & (s["exclaimed"] > 0.25), s["exclaimed"] < 0.05),
    ]


def toxic_votes(block: Block) -> list[np.ndarray]:
    """One-sided labellers with lists of their own: what finds nothing abstains."""
    none = np.zeros(block.rows, bool)
    return [_vote(block.stats[name] > 0, none) for name in INSULTS]


#: Task to its labellers.
TASKS = {"junk": junk_votes, "toxic": toxic_votes}
#: The kind of each labeller: noise, repetition and shouting; insults.
KINDS = {"junk": (0, 0, 1, 1, 2, 2), "toxic": (0, 0, 0)}


def codes(votes: list[np.ndarray]) -> np.ndarray:
    """A vote pattern as one number."""
    out = np.zeros(len(votes[0]), np.int64)
    for v in votes:
        out = out * 3 + v
    return out


def decode(code: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(labellers - 1, -1, -1)], axis=1)


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, kinds: tuple[int, ...], rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of rejection for each vote pattern (rows of ``votes``), and P(vote | class) by labeller, class and vote.

    Class 0 is accepted. Text is rejected for different reasons, so each kind of heuristic (``kinds`` has the number
    of each one's kind) has a rejected class of its own, and one more class holds what no heuristic sees. A
    heuristic's abstention is an outcome of its own; the last labeller is the annotator, whose abstention is only a missing
    vote. Pseudo-counts hold that heuristics raise few false alarms.
    """
    labellers, classes = votes.shape[1], 3 + max(kinds)
    fired = votes[:, :-1] == REJECT
    gold = votes[:, -1]
    weight = np.full((len(votes), classes), 0.02)
    weight[:, 0] = np.where(gold == REJECT, 0.001, np.where(fired.any(axis=1), 0.1, 1.0))
    for i, kind in enumerate(kinds):
        weight[fired[:, i], 1 + kind] += 1
    weight[(gold == REJECT) & ~fired.any(axis=1), -1] += 1
    weight[gold == ACCEPT, 1:] *= 0.02
    weight /= weight.sum(axis=1, keepdims=True)
    table = np.zeros((labellers, classes, 3))
    prior = np.full((labellers, classes, 3), 1.0)
    for _ in range(rounds):
        for i in range(labellers):
            for c in range(classes):
                table[i, c] = np.bincount(votes[:, i], count * weight[:, c], 3) + prior[i, c]
        table /= table.sum(axis=2, keepdims=True)
        table[-1] = [1 - ANNOTATOR, ANNOTATOR, 1]  # an abstention is only missing
        table[-1, 0] = [ANNOTATOR, 1 - ANNOTATOR, 1]
        # Accepted rows raise few false alarms: a prior with the weight of all rows.
        alarms = (count @ weight[:, 0] * table[:-1, 0, REJECT] + FALSE_ALARMS * count.sum()) / (count @ weight[:, 0] + count.sum() + 1)
        table[:-1, 0] *= ((1 - alarms) / (1 - table[:-1, 0, REJECT]))[:, None]
        table[:-1, 0, REJECT] = alarms
        # What no heuristic sees looks accepted to all of them.
        table[:-1, -1] = table[:-1, 0]
        table[:-1, -1, REJECT] = np.minimum(table[:-1, 0, REJECT], FALSE_ALARMS / 10)
        share = count @ weight + 1
        logs = np.log(share / share.sum()) + sum(np.log(table[i][:, votes[:, i]]).T for i in range(labellers))
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - weight).max(initial=0) < 1e-9:
            break
        weight = new
    return 1 - weight[:, 0], table


#: Statistics that are features, and how many bins make one.
BINNED = (("symbols", 20), ("stops", 50), ("again", 20), ("distinct", 10), ("capitals", 10), ("exclaimed", 20))
BIN_PLACES = np.arange(len(BINNED) * 10) * 2654435761 % DIMENSIONS


def hashed(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features: distinct words and binned statistics, hashed. Returns places, and ends by row."""
    bins = []
    for number, (name, scale) in enumerate(BINNED):
        level = np.minimum(9, (block.stats[name] * scale).astype(np.int64))
        bins.append(BIN_PLACES[number * 10 + level])
    row = np.concatenate((block.pair_row, np.tile(np.arange(block.rows), len(bins))))
    place = np.concatenate(((block.pair_word >> np.uint64(24)).astype(np.int64) % DIMENSIONS, *bins))
    order = np.argsort(row, kind="stable")
    return place[order], np.cumsum(np.bincount(row, minlength=block.rows))


def useful(places: np.ndarray) -> np.ndarray:
    """Which features get a weight: those of ``LEAST_ROWS`` rows of the sample or more."""
    return np.bincount(places, minlength=DIMENSIONS) >= LEAST_ROWS


def train(places: np.ndarray, ends: np.ndarray, target: np.ndarray, rounds: int = 200, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer, by accelerated full gradients.

    Features are scaled by their rarity while training, so that a telling word of a few rows counts beside
    words that many rows have.
    """
    out = np.zeros(DIMENSIONS + 1)
    full = np.diff(ends, prepend=0) > 0
    ends, target = ends[full], target[full]
    n = len(ends)
    if not n:
        return out
    sizes = np.diff(ends, prepend=0)
    begins = ends - sizes
    seen = np.bincount(places, minlength=DIMENSIONS)
    features, names = np.unique(places, return_inverse=True)
    scale = np.minimum(1 / np.sqrt(seen[features] / n), 8.0)
    scale[np.isin(features, BIN_PLACES)] *= 3  # statistics of the whole text, dense and few
    x = scale[names]
    # A bound on the curvature: the largest column sum of the rows' own sums.
    row_sums = np.add.reduceat(x, begins)
    bound = 0.25 * (np.bincount(names, x * np.repeat(row_sums, sizes), len(features)).max(initial=1.0) / n + 1)
    rate = 1 / (bound + decay)
    w = v = np.zeros(len(features))
    bias = v_bias = float(np.log(np.clip(target.mean(), 1e-4, 1 - 1e-4) / np.clip(1 - target.mean(), 1e-4, 1)))
    for k in range(1, rounds + 1):
        logits = np.add.reduceat(v[names] * x, begins) + v_bias
        error = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - target) / n
        w_next = v - rate * (np.bincount(names, np.repeat(error, sizes) * x, len(features)) + decay * v)
        bias_next = v_bias - rate * error.sum()
        push = (k - 1) / (k + 2)
        v, v_bias = w_next + push * (w_next - w), bias_next + push * (bias_next - bias)
        w, bias = w_next, bias_next
    out[features] = w * scale
    out[-1] = bias
    return out


def score(places: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[places], len(ends)) + weights[-1], -50, 50)))


@dataclass
class Model:
    """Scorer weights, labeller accuracies, and (codes, posteriors) of the patterns that no annotator voted on."""

    weights: dict[str, np.ndarray]
    accuracies: dict[str, np.ndarray]
    posteriors: dict[str, tuple[np.ndarray, np.ndarray]]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Scores by task, and the rows to keep."""
        block = read_block(data, offsets)
        places, ends = hashed(block)
        scores, keep = {}, np.ones(block.rows, bool)
        for task, votes in TASKS.items():
            scores[task] = score(places, ends, self.weights[task])
            known, posterior = self.posteriors[task]
            code = codes(votes(block))
            sure = np.zeros(block.rows, bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                sure = (known[at] == code) & (posterior[at] >= CERTAIN)
            keep &= (scores[task] < THRESHOLD) & ~sure
        return scores, keep


def _gold(labels: DataFrame | None, spark) -> DataFrame:
    """One row per labelled key: the annotator's vote on each task, as one more labeller."""
    if labels is None:
        return spark.createDataFrame([], "gold_key long, junk_gold long, toxic_gold long")
    rows = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("gold_key")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    vote = lambda c, reject: F.when(F.col(c).isNull(), ABSTAIN).when(F.col(c) == reject, REJECT).otherwise(ACCEPT).cast("long")
    return rows.select("gold_key", vote("quality", 0).alias("junk_gold"), vote("toxic", 1).alias("toxic_gold"))


def _voted(docs: DataFrame, gold: DataFrame, with_features: bool) -> DataFrame:
    """Vote patterns of (key, text) rows, narrow, with the annotators' votes; and the features where asked for."""
    names = list(TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, 1):
                block = read_block(*text_bytes(batch.column(1).slice(a, b - a)))
                columns = [batch.column(0).slice(a, b - a), *(pa.array(codes(v(block))) for v in TASKS.values())]
                if with_features:
                    places, ends = hashed(block)
                    begins = np.concatenate(([0], ends[:-1]))
                    columns.append(pa.array([places[x:y].astype(np.int32).tobytes() for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", *names, *["places"] * with_features])

    schema = "key long, " + ", ".join(f"{n} long" for n in names) + ", places binary" * with_features
    joined = docs.mapInArrow(run, schema).join(gold, F.col("key") == F.col("gold_key"), "left")
    return joined.select(*(F.col(n) * 3 + F.coalesce(f"{n}_gold", F.lit(ABSTAIN)) for n in names), *["places"] * with_features).toDF(*names, *["places"] * with_features)


def fit(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id") -> Model:
    """Labeller accuracies from the patterns of all rows; scorers from a bounded sample.

    ``labels`` (doc_id, quality, toxic), where given, are one more labeller, silent on unlabelled rows. The sample is
    an expected ``train_rows`` labelled rows and half as many of all rows, chosen by hashes of
    keys and texts, and of ``TRAIN_BYTES`` at most; equal feature rows count once, so no group of copies floods it.
    ``key`` is an integer column, as in ``labels``.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be an integer column")
    spark = docs.sparkSession
    ship(spark)
    names = list(TASKS)
    gold = _gold(labels, spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = _voted(rows, gold, False).groupBy(*names).agg(F.count("*").alias("n")).collect()  # bounded by the number of patterns
    posteriors, accuracies = {}, {}
    for task, kinds in KINDS.items():
        sums: dict[int, int] = {}
        for r in counts:
            sums[r[task]] = sums.get(r[task], 0) + r["n"]
        code = np.array(sorted(sums), np.int64)
        posterior, accuracies[task] = expectation_maximisation(decode(code, len(kinds) + 1), np.array([sums[c] for c in code.tolist()], np.float64), kinds)
        posteriors[task] = dict(zip(code.tolist(), posterior.tolist(), strict=True))
    whole = 1 << 30
    part = lambda n, total: F.lit(min(whole, int(whole * n / max(1, total))))
    labelled = gold.filter(F.pmod(F.xxhash64("gold_key"), F.lit(whole)) < part(train_rows, gold.count())).select(F.col("gold_key").alias("picked"))
    picked = F.broadcast(labelled)  # an expected train_rows keys
    some = F.pmod(F.xxhash64("text"), F.lit(whole)) < part(train_rows // 2, sum(r["n"] for r in counts))
    chosen = rows.join(picked, F.col("key") == F.col("picked"), "left").filter(some | F.col("picked").isNotNull()).select("key", "text")
    drawn = stored(_voted(chosen, gold, True).distinct())  # about 1.5 * train_rows rows
    size = drawn.agg(F.coalesce(F.sum(F.octet_length("places")), F.lit(0))).first()[0]
    thin = F.pmod(F.xxhash64("places", F.lit(1)), F.lit(whole)) < part(TRAIN_BYTES, max(size, TRAIN_BYTES))
    sample = drawn.filter(thin).collect()  # TRAIN_BYTES expected
    sample.sort(key=lambda r: (bytes(r["places"]), *(r[t] for t in names)))
    targets = {t: np.array([posteriors[t][r[t]] for r in sample]) for t in names}
    sizes = np.array([len(r["places"]) // 4 for r in sample], np.int64)
    places = np.frombuffer(b"".join(r["places"] for r in sample), np.int32)
    del sample
    # Features of a few rows are not trained on; they go before anything is widened.
    used = useful(places)[places]
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[used], minlength=len(sizes))
    places, ends = places[used].astype(np.int64), np.cumsum(sizes)
    del used
    weights = {t: train(places, ends, targets[t]) for t in names}
    silent = {t: sorted((c // 3, q) for c, q in known.items() if c % 3 == ABSTAIN) for t, known in posteriors.items()}
    return Model(weights, accuracies, {t: (np.array([c for c, _ in x], np.int64), np.array([q for _, q in x])) for t, x in silent.items()})


def classify(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, p_junk, p_toxic and kept.

    A row is rejected where a scorer reaches ``THRESHOLD``, or where its heuristics alone are ``CERTAIN``.

    Null and empty texts have no features but the bins of zeros. Rows are independent; repeated
    ones get equal scores. Other columns are ignored. The model is fitted on ``docs`` itself where none is given.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, text=text, key=key) if model is None else model)  # two weight arrays of DIMENSIONS
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for a, b in blocks(batch, 1):
                p, keep = held.judge(*text_bytes(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p["junk"]), pa.array(p["toxic"]), pa.array(keep)], names=["key", "p_junk", "p_toxic", "kept"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, p_junk double, p_toxic double, kept boolean").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows, all columns, that ``classify`` keeps: null, empty and repeated rows are judged like any other."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, text=text, key=key) if model is None else model)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for a, b in blocks(batch, column):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(held.judge(*text_bytes(part.column(column)))[1]))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
