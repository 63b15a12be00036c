"""Periodic runs, hard negatives and exact duplicates against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact, negatives, periods, queries
from lodestone.llm.common import Words, text_bytes

from . import brute
from .test_llm import EXTRA, SCHEMA, TEXTS


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(TEXTS, SCHEMA)
    for name in (*EXTRA, "row", "grp", "lead", "win", "runs", "keep"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# 11 periodic runs


def random_words(rng):
    out = []
    for _ in range(rng.randint(0, 8)):
        base = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([1, 2, 2, 3, 5, 9, 14, 30]))]
        out += (base * rng.choice([1, 1, 3, 4, 8, 12]))[: -rng.randint(1, len(base)) or None]
        out += [str(rng.random()) for _ in range(rng.choice([0, 0, 1, 3]))]
    return out


@pytest.mark.parametrize(("least", "power"), [(24, 3), (8, 2), (10, 4)])
def test_runs_of_random_words(least, power):
    rng = random.Random(least)
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        found = periods.runs_of(Words(*text_bytes(pa.array([" ".join(t) for t in texts]))), least, power)
        got = [[] for _ in texts]
        for row, *run in zip(*(x.tolist() for x in found), strict=True):
            got[row].append(tuple(run))
        assert got == [brute.runs(t, least, power) for t in texts]


def test_runs_where_hashes_collide(monkeypatch):
    """Runs are compared word by word, and a block with collisions is searched again without hashes."""
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(20)]
    words = Words(*text_bytes(pa.array([" ".join(t) for t in texts])))
    want = [x.tolist() for x in periods.runs_of(words)]
    asked = []
    monkeypatch.setattr(periods.Compared, "ahead", lambda self, i, j, f=periods.Compared.ahead: asked.append(1) or f(self, i, j))
    monkeypatch.setattr(periods.Extensions, "_same", lambda self, a, b, n: np.ones(len(a), bool))
    assert [x.tolist() for x in periods.runs_of(words)] == want and asked


def test_least_overlap():
    for least, power in ((24, 3), (8, 2), (7, 5), (1, 2)):
        assert periods.least_overlap(least, power) == min(max(least, power * q) - q for q in range(1, 200))


@pytest.mark.parametrize("words", [["same"] * 200_000, list("abcdefg") * 30_000, ["ab"[i.bit_count() % 2] for i in range(1 << 16)], [f"w{i}" for i in range(100_000)] * 2])
def test_runs_of_long_texts(words):
    found = periods.runs_of(Words(*text_bytes(pa.array([" ".join(words)]))))
    want = [(0, 200_000, 1)] if words[0] == "same" else [(0, 210_000, 7)] if words[2] == "c" else []
    assert list(zip(*(x.tolist() for x in found[1:]), strict=True)) == want


def plain_op11(rows):
    out = []
    for key, text in rows:
        w, h = brute.words(text), zlib.crc32(str(key).encode()) if key is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute.runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda r: (r[1] * math.lcm(*range(1, 60)) // r[2] if r[2] < 60 else r[1] / r[2] * math.lcm(*range(1, 60)), -r[0], -r[2]), default=None)
        out.append((key, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def test_op11(spark, data, docs):
    got = queries.op11_periodic_runs(spark, data).collect()
    assert Counter(map(tuple, got)) == Counter(plain_op11([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_collapse_awkward(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periods.collapse(awkward).collect())
    want = []
    for key, text in rows:
        w = brute.words(text)
        runs = [(0, 80_000, 4)] if len(w) > 50_000 else brute.runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        want.append((key, len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == Counter(want)
    assert periods.collapse(empty).count() == 0 and periods.planted(empty).count() == 0
    assert [r["text"] for r in periods.planted(awkward).filter("doc_id is null").collect()] == [t for k, t in rows if k is None]


def test_longest_run(spark):
    rows = spark.createDataFrame([(1, [(0, 30, 3), (40, 60, 6), (90, 33, 3)]), (2, []), (3, [(5, 30, 3), (7, 40, 4)])], "id int, runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in rows.select(periods.longest(F.col("runs"))).collect()] == [(90, 33, 3), None, (5, 30, 3)]


# 12 hard negatives

VECTORS = "vec_id long, label int, embedding array<double>, uid string, norm string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(3)


def mined(rows, frame, **options):
    """The operator and brute force on the same rows, as multisets."""
    got = negatives.mine(frame, F.col("vec_id") % 10 == 0, **options).collect()
    return Counter(map(tuple, got)), Counter(brute.negatives(rows, **options))


@pytest.mark.parametrize("spread", [3, 40])
def test_mining(spark, monkeypatch, spread):
    """Small buckets and blocks, norms alike and unlike, many ties."""
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 7)
    monkeypatch.setattr(negatives, "STRIPE_ROWS", 20)
    monkeypatch.setattr(negatives, "FIRST", 2)
    rng = np.random.default_rng(spread)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 4) * (1 + i % spread)]) for i in range(240)]
    got, want = mined(rows, vectors(spark, rows))
    assert got == want and sum(got.values()) > 50
    got, want = mined(rows, vectors(spark, rows), positives=2, negatives=3, low=50, high=90)
    assert got == want


def test_mining_awkward(spark):
    """Null and non-finite parts, null and repeated keys, zero and unlike vectors, vectors beyond 2**26, a hot label, no rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (10, 1, [0.0, 0.0]), (20, None, [1.0, 1.0]), (30, 1, None), (40, 1, [1.0, None]), (50, 1, [nan, 1.0]), (60, 1, [inf, 1.0]), (70, 1, []), (80, 2, [1.0, 2.0, 3.0]), (None, 1, [2.0, 1.0]), (None, 2, [2.0, 1.0]), (None, 2, [1.0, 2.0])]
    rows += [(100 + i, 1 + i % 5 // 4, [float(1 << 27), float(i)]) for i in range(40)] + [(500, 3, [float(1 << 40), 0.0]), (510, 1, [-5.0, -7.0])]
    got, want = mined(rows, vectors(spark, rows))
    assert got == want and got
    assert negatives.mine(vectors(spark, [(0, None, None)]), F.col("vec_id") == 0).count() == 0


def test_few_buckets_are_met(spark, monkeypatch):
    """With falling norms a block of anchors is not joined with stripes that cannot reach its k-th scores."""
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 8)
    monkeypatch.setattr(negatives, "STRIPE_ROWS", 16)
    rows = [(i, i % 2, [float(1 + (400 - i) ** 2), 1.0]) for i in range(400)]
    met = []
    monkeypatch.setattr(negatives, "_scored", lambda pairs, same, k, f=negatives._scored: met.append(pairs.count()) or f(pairs, same, k))
    got, want = mined(rows, vectors(spark, rows))
    # Norms fall with the fourth power: of some 300 pairs of a block and a bucket, the first round of positives leaves none.
    assert got == want and len(met) == 4 and 0 < met[0] < 50 and met[1] == 0 and met[2] + met[3] < 150


def test_op12_of_fractions(spark, tmp_path):
    """Labels are shifted, components scaled and floored; rows with a component that is not finite take no part."""
    rng = np.random.default_rng(12)
    rows = [(10 * i, int(rng.integers(0, 10)), [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(7, None, [1.0] * 6), (8, 3, None), (9, 3, [math.nan] * 6), (10**6, 3, [math.inf] + [1.0] * 5)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = [(k // 10, (c + 1) % 10 if c is not None and k % 7 == 0 else c, [math.floor(256 * x) if math.isfinite(x) else x for x in v] if v else v) for k, c, v in rows if k not in (7, 8, 9)]
    got = queries.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((10 * a, 10 * p, r, 10 * n, x, y) for a, p, r, n, x, y in brute.negatives(plain)) and got


# 13 exact duplicates


def same_groups(frame):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    by = {}
    for k, t in rows:
        by.setdefault(brute.lower(t), []).append(k)
    got = exact.dedupe(frame).collect()
    named = {t: max((k for k in ks if k is not None), default=None) for t, ks in by.items()}
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got) == Counter((k, named[t], len(ks), brute.sha(t)) for t, ks in by.items() for k in ks)
    kept = [r for r in got if r["kept"]]
    assert Counter(bytes(r["digest"]).hex() for r in kept) == Counter(brute.sha(t) for t in by) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_dedupe(awkward, docs, empty):
    same_groups(awkward)
    same_groups(docs)
    assert exact.dedupe(empty).count() == 0
    assert exact.dedupe(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).filter("kept").count() == exact.dedupe(docs).filter("kept").count()
    with pytest.raises(TypeError):
        exact.dedupe(docs.withColumn("doc_id", F.array("doc_id")))


def test_dedupe_spills_and_hot_contents(spark, docs, monkeypatch):
    """Tables of few bytes: tasks empty theirs, buckets spill over several passes, and a content of a third of all rows is gathered in parts."""
    monkeypatch.setattr(exact, "TABLE_BYTES", 8_000)
    monkeypatch.setattr(exact, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(exact, "HOT_RECORDS", 3)
    passes = []
    monkeypatch.setattr(exact, "_passed", lambda records, kind, level, contents, *salt, f=exact._passed: passes.append(level) or f(records, kind, level, contents, *salt))
    hot = spark.range(300).select(F.col("id") + 10_000, F.when(F.col("id") % 2 == 0, "Hot text").otherwise("hot TEXT"))
    same_groups(docs.select("doc_id", "text").limit(60).unionByName(hot.toDF("doc_id", "text")).repartition(16))
    assert 0 in passes and max(passes) > 2


def test_table_compares_contents():
    """Contents of one hash are told apart, and the table grows."""
    table, rng = exact.Table(2), random.Random(3)
    contents = list({bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(500)})
    for i, x in enumerate(contents):
        own = table.find(x, i % 3)
        assert own < 0 and table.add(x, i % 3, -1 - own) == i
    assert [table.find(x, i % 3) for i, x in enumerate(contents)] == list(range(len(contents))) and table.find(b"c", 1) < 0
    assert [table.content(i) for i in range(len(table))] == contents


# candidates of the pipeline's near-dedup


def test_recall_of_bands():
    """Pairs of five-word similarity 0.8 to 0.85, texts of 25 to 400 words with words replaced, dropped or put in: how many share a band."""
    from lodestone.llm import similar

    rng = random.Random(8)
    vocabulary, texts = [f"w{i}" for i in range(4000)], []
    while len(texts) < 3000:
        one = [rng.choice(vocabulary) for _ in range(rng.choice([25, 40, 80, 150, 400]))]
        two = list(one)
        for _ in range(max(1, len(one) // rng.randint(40, 70))):
            i = rng.randrange(len(two))
            two[i : i + 1] = rng.choice([[rng.choice(vocabulary)], [], [two[i], rng.choice(vocabulary)]])
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two)]
        if 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) <= 0.85:
            texts += [" ".join(one), " ".join(two)]
    bands = similar.sketch(*similar.shingle_sets(*text_bytes(pa.array(texts))))[1]
    met = (bands[::2] == bands[1::2]).any(axis=1)
    assert met.mean() >= 0.998


@pytest.mark.parametrize("rows", [10_000, 7])  # one batch of all parts; parts that go over several batches
def test_parts_are_compared_in_blocks(monkeypatch, rows):
    """Texts of parts are hashed about a block at a time, however many bytes a batch has; each part's groups equal brute force over all its pairs."""
    from lodestone.llm import common, similar

    rng, texts, at_once = random.Random(4), [], []
    for part in range(-30, 30):
        for _ in range(4):
            one = [f"word{rng.randrange(10**6)}" for _ in range(rng.choice([1, 200, 900]))]
            for changed in (0, 1, 2, len(one) // 20):
                copy = list(one)
                for at in rng.sample(range(len(one)), min(changed, len(one))):
                    copy[at] = "other"
                texts.append((part, len(texts), " ".join(copy)))
    total, largest = (f([len(t) for _, _, t in texts]) for f in (sum, lambda x: max(sum(x[i : i + 16]) for i in range(0, len(x), 16))))
    assert total > 3 * common.BLOCK_BYTES
    sets = similar.shingle_sets
    monkeypatch.setattr(similar, "shingle_sets", lambda data, offsets, shingle: (at_once.append(len(data)), sets(data, offsets, shingle))[1])
    table = pa.table({name: pa.array(column) for name, column in zip(("part", "fp", "text"), zip(*texts))})
    links = pa.Table.from_batches(similar._compare(5, 0.8)(iter(table.to_batches(rows)))).to_pydict()
    assert sum(at_once) == total and max(at_once) <= common.BLOCK_BYTES + largest
    root = list(range(len(texts)))
    for a, b in zip(links["a"], links["b"]):
        assert texts[a][0] == texts[b][0]
        root = [root[a] if r == root[b] else r for r in root]
    for part in range(0, len(texts), 16):
        mine = texts[part : part + 16]
        heads = brute.similar_heads(range(16), [t for _, _, t in mine], range(16))
        assert len({root[i] for _, i, _ in mine}) == len(heads)
        assert len({root[part + h] for h in heads}) == len(heads)
