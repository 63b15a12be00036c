"""The thin queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, dac, decontaminate, exact, negatives, periods, rules, secrets, sharding, simhash, sql, substrings, warc
from .common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    digests = stored(parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
    substrings.forget(spark)
    return digests


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.codec(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse(periods.planted(table(spark, sf_dir, "documents")))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumn("top", periods.longest(F.col("runs")))
    parts = [F.col(f"top.{x}").alias(x) for x in ("start", "length", "period")]
    milli = F.expr("1000 * top.length div top.period AS exponent_milli")
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *parts, milli, F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, label = table(spark, sf_dir, "embeddings"), F.col("label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    # NaN and infinity stay as they are, for the operator to leave out.
    scaled = F.transform("embedding", lambda x: F.when(F.abs(256 * x.cast("double")) < float(1 << 62), F.floor(256 * x.cast("double")).cast("double")).otherwise(x.cast("double")))
    return negatives.mine(rows.select("vec_id", shifted.alias("label"), scaled.alias("embedding")), F.col("vec_id") % 100 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.dedupe(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_substring_dedup, op4_warc_archives, op5_quality_classifier, op6_secret_scans, op7_decontamination, op8_simhash, op9_token_files, op10_bpe_codec, op11_periodic_runs, op12_hard_negatives, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": rules.SQL, "op3_substring_dedup": sql.OP3, "op4_warc_archives": sql.OP4, "op7_decontamination": sql.OP7, "op12_hard_negatives": sql.OP12, "op13_exact_dedup": sql.OP13}
