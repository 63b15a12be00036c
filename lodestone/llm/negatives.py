"""Hard negatives by norm-bucketed inner-product search.

Candidates are sorted by norm, cut into stripes and those into buckets, each with its greatest norm. Anchors are packed in blocks. For
every anchor, windows of scores are searched for the ``k`` greatest scores within; by Cauchy-Schwarz a bucket has no score above the
product of its norm and the anchor's, so it is of no use to a window whose lower limit, or whose running k-th score, is
greater. The buckets of greatest norm, few and bounded in bytes, are searched first; the k-th scores found there decide which stripes
a block of anchors still meets, joined by the stripe's number, and within a task the running scores decide which anchors meet a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, stored

#: Bytes of vectors of a bucket and of a block of anchors, and rows of either at most.
BUCKET_BYTES, BUCKET_ROWS = 1 << 19, 2048
#: Rows of a stripe, where there are enough for every task to have one.
STRIPE_ROWS = 1 << 16
#: Buckets of greatest norm that are searched first.
FIRST = 8
#: Squared norms from here on may give scores beyond a long; such rows take no part.
LONG = float(1 << 62)
#: What rounding may take from a product of norms.
SLACK = 1 + 1e-9
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def points(rows: DataFrame, is_anchor: Column, key: str, label: str, vector: str) -> DataFrame:
    """uid, anchor, id, label, v (longs), norm of the rows that take part: no null label or vector, every component an integer in a long."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(LONG)))
    longs = F.transform(v, lambda x: x.cast("long"))
    square = F.aggregate(longs, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    named = rows.filter(F.col(label).isNotNull() & v.isNotNull() & whole).select(F.monotonically_increasing_id().alias("uid"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), longs.alias("v"), F.sqrt(square).alias("norm"))
    return named.filter(F.col("norm") < F.lit(LONG**0.5))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    m = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(lists), 0), np.int64)
    most = int(np.abs(m).max(initial=0))
    return m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(dimension, rows of that dimension), in order, each of ``most`` rows and a bucket's bytes at most; one may be cut short at the end of a batch."""
    for batch in batches:
        dims = np.diff(batch.column(column).offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
        for dim in np.unique(dims).tolist():
            rows = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
            size = max(1, min(most, BUCKET_BYTES // (2 * max(1, dim))))
            for at in range(0, rows.num_rows, size):
                yield dim, rows.slice(at, size)


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays]


def _column(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    column = batch.column(name)
    return (column.fill_null(null) if column.null_count else column).to_numpy(zero_copy_only=False)


def _bucketed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, place = TaskContext.get().partitionId(), 0
        for dim, rows in _pieces(batches, "v", most):
            m, unnamed = _matrix(rows.column("v"), dim), rows.column("id").is_null().to_numpy(zero_copy_only=False)
            packed = _bytes(_column(rows, "uid"), _column(rows, "id", MOST), unnamed, _column(rows, "label"), m)
            yield pa.RecordBatch.from_arrays([pa.array([stripe]), pa.array([place]), pa.array([float(_column(rows, "norm").max())]), pa.array([dim]), pa.array([m.dtype.str]), *packed], names=["stripe", "place", "top", "dim", "kind", "c_uid", "c_id", "c_unnamed", "c_label", "c_v"])
            place += 1

    return run


def buckets(held: DataFrame) -> DataFrame:
    """The stored buckets of the stored table ``held``, stripes by falling norm."""
    n = held.count()
    stripes = max(1, -(-n // STRIPE_ROWS), min(2 * held.sparkSession.sparkContext.defaultParallelism, n // BUCKET_ROWS))
    ordered = held.repartitionByRange(stripes, F.desc("norm"), F.col("uid")).sortWithinPartitions(F.desc("norm"))
    return stored(ordered.mapInArrow(_bucketed(BUCKET_ROWS), "stripe long, place long, top double, dim long, kind string, c_uid binary, c_id binary, c_unnamed binary, c_label binary, c_v binary"))


def _needs(low: np.ndarray, high: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The least score that is of use to any window of each anchor, or a double just below it."""
    return np.where(low <= high, np.nextafter(np.maximum(low, seen).astype(np.float64), -np.inf), np.inf).min(axis=1, initial=np.inf)


def _blocked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for dim, rows in _pieces(batches, "v", most):
            lists, m, norm = rows.column("windows"), _matrix(rows.column("v"), dim), _column(rows, "norm")
            sizes = np.diff(lists.offsets.to_numpy())
            width = max(1, int(sizes.max()))
            at = np.arange(width) < sizes[:, None]
            limits = []
            for name, none in (("low", MOST), ("high", LEAST), ("seen", LEAST)):
                limits.append(np.full(at.shape, none, np.int64))
                limits[-1][at] = lists.flatten().field(name).to_numpy(zero_copy_only=False)
            needs = _needs(*limits)
            least = float(np.where(needs <= 0, 0.0, np.divide(needs, norm, out=np.full(len(norm), np.inf), where=norm > 0)).min())
            packed = _bytes(_column(rows, "uid"), _column(rows, "label"), norm, m, *limits)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([least]), pa.array([dim]), pa.array([m.dtype.str]), *packed], names=["block", "least", "a_dim", "a_kind", "a_uid", "a_label", "a_norm", "a_v", "a_low", "a_high", "a_seen"])
            block += 1

    return run


def _blocks(anchors: DataFrame) -> DataFrame:
    schema = "block long, least double, a_dim long, a_kind string, a_uid binary, a_label binary, a_norm binary, a_v binary, a_low binary, a_high binary, a_seen binary"
    return stored(anchors.select("uid", "label", "norm", "v", "windows").mapInArrow(_blocked(BUCKET_ROWS), schema))


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: as doubles where none reaches 2**53."""
    kind = np.float64 if bound < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


class _Block:
    """A block of anchors in a task, and the best candidates of its windows so far."""

    def __init__(self, row: dict, k: int):
        read = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
        self.k, self.dim = k, row["a_dim"]
        self.uid, self.label, self.norm = read("a_uid"), read("a_label"), read("a_norm", np.float64)
        n = len(self.uid)
        self.v = read("a_v", row["a_kind"]).reshape(n, self.dim)
        self.low, self.high, self.seen = (read(x).reshape(n, -1).copy() for x in ("a_low", "a_high", "a_seen"))
        self.best = [np.zeros(0, x) for x in (np.int64, np.int64, bool, np.int64)]  # window, score, unnamed, id

    def meet(self, row: dict, same: bool) -> None:
        if row["dim"] != self.dim:
            return
        needs = _needs(self.low, self.high, self.seen)
        near = np.flatnonzero(self.norm * row["top"] * SLACK >= needs)
        if not len(near):
            return
        uid, name, unnamed, label = (np.frombuffer(row[x], kind) for x, kind in (("c_uid", np.int64), ("c_id", np.int64), ("c_unnamed", bool), ("c_label", np.int64)))
        vectors = np.frombuffer(row["c_v"], row["kind"]).reshape(len(uid), self.dim)
        scores = _products(self.v[near], vectors, float(self.norm[near].max()) * row["top"])
        use = (scores >= needs[near, None]) & ((self.label[near, None] == label) == same)
        if same:
            use &= self.uid[near, None] != uid
        a, c = np.nonzero(use)
        score, a, width = scores[a, c].astype(np.int64), near[a], self.low.shape[1]
        new = [self.best]
        for w in range(width):
            good = (score >= np.maximum(self.low, self.seen)[a, w]) & (score <= self.high[a, w])
            new.append([a[good] * width + w, score[good], unnamed[c[good]], name[c[good]]])
        window, score, unnamed, name = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.lexsort((name, unnamed, -score, window))
        window = window[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        kept = order[place < self.k]
        self.best = [window[place < self.k], score[kept], unnamed[kept], name[kept]]
        full = order[place == self.k - 1]
        self.seen.reshape(-1)[window[place == self.k - 1]] = score[full]

    def found(self) -> pa.RecordBatch:
        window, score, unnamed, name = self.best
        width = self.low.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(self.uid[window // width]), pa.array((window % width).astype(np.int32)), pa.array(score), pa.array(name, mask=unnamed)], names=["uid", "window", "score", "id"])


def _scored(pairs: DataFrame, same: bool, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("dim", "kind", "top", "c_uid", "c_id", "c_unnamed", "c_label", "c_v")}
                now = batch.column("block")[i].as_py()
                if now != number:  # a join's rows come block by block
                    if block is not None:
                        yield block.found()
                    block, number = _Block({name: batch.column(name)[i].as_py() for name in batch.schema.names if name.startswith("a_")}, k), now
                block.meet(row, same)
        if block is not None:
            yield block.found()

    return pairs.mapInArrow(run, "uid long, window int, score long, id long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("uid", "window").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(anchors: DataFrame, held: DataFrame, same: bool, k: int) -> DataFrame:
    """uid, window (from 0), rank (from 1), score and id of the ``k`` best candidates in every window of every anchor; ties by id, null last.

    ``anchors`` has uid, label, norm, v and windows (array of low, high, both included); ``held`` are ``buckets``. Candidates have the
    anchor's label and another uid, or another label where not ``same``. Vectors of unlike lengths never meet.
    """
    blank = F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.lit(LEAST).cast("long").alias("seen")))
    anchors = anchors.withColumn("windows", blank)
    ends = held.agg(F.min("stripe"), F.max("stripe")).first()
    if ends[0] is None:
        return held.sparkSession.createDataFrame([], "uid long, window int, score long, id long, rank int")
    early = (F.col("stripe") == ends[0]) & (F.col("place") < FIRST)
    # At most FIRST buckets of BUCKET_BYTES' vectors: a broadcast of bounded size, joined by the bucket's place.
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FIRST - 1).cast("long")))
    first = stored(_best(_scored(_blocks(anchors).withColumn("place", places).join(F.broadcast(held.filter(early)), "place"), same, k), k))
    seen = first.filter(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    known = F.transform("windows", lambda w, i: w.withField("seen", F.coalesce(F.try_element_at("kth", i), w["seen"])))
    blocks = _blocks(anchors.join(seen, "uid", "left").withColumn("windows", known))
    stripes = held.groupBy("stripe").agg(F.max("top").alias("reach"))
    left = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(ends[0]), F.lit(ends[1])))).join(stripes, "stripe").filter(F.col("reach") * SLACK >= F.col("least"))
    rest = left.drop("reach").join(held.filter(~early).hint("merge"), "stripe")
    return _best(first.drop("rank").unionByName(_scored(rest, same, k)), k)


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor's hard negatives.

    ``vector`` holds integers. An anchor's positives are the ``positives`` other rows of its label with the greatest inner products; for each,
    the ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's are returned.
    Ties go to the smaller key, null last. Rows without a label, a vector or with a component that is null, not finite or beyond
    2**62 take no part, nor do those whose squared norm reaches 2**62. Vectors of unlike lengths never meet; repeated rows are
    rows of their own, so a copy is another row. A positive with a negative score has an empty window. Other columns are ignored.
    """
    ship(rows.sparkSession)
    used = stored(points(rows, is_anchor, key, label, vector))
    held, anchors = buckets(used), used.filter("anchor").drop("anchor")
    whole = F.array(F.struct(F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high")))
    near = stored(search(anchors.withColumn("windows", whole), held, True, positives).drop("window"))
    part = lambda score, share: score.cast("decimal(20,0)") * F.lit(share).cast("decimal(20,0)") / F.lit(100).cast("decimal(20,0)")
    limits = lambda p: F.struct(F.ceil(part(p["score"], low)).cast("long").alias("low"), F.floor(part(p["score"], high)).cast("long").alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "score")))
    windows = near.groupBy("uid").agg(F.transform(ordered, limits).alias("windows"))
    found = search(anchors.join(windows, "uid"), held, False, negatives).select("uid", "window", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    pairs = near.select("uid", (F.col("rank") - 1).alias("window"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    named = found.join(pairs, ["uid", "window"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
