"""Listings, logs and sinks over relational rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(base: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """``base`` left-joined with children that are already aggregated to one row a key."""
    for child in children:
        base = base.join(child, key, "left")
    return base


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page of an ordered listing (order has to be total)."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def latest(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in ``order``, with their number."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("n") <= n)


def json_long(column: str, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}").try_cast("long")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced by those of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row a key, the new one where both have it."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_age"))).filter("_n = 1").drop("_age", "_n")


def unseen_uploads(incoming: DataFrame, files: DataFrame) -> DataFrame:
    """Supported, non-empty files whose (filename, file_size) is new, each once."""
    good = incoming.filter((F.col("file_size") > 0) & F.lower("filename").rlike(r"\.(pdf|docx|txt|md)$"))
    return good.dropDuplicates(["filename", "file_size"]).join(files.select("filename", "file_size"), ["filename", "file_size"], "left_anti")


def keep_best(rows: DataFrame, keys: list[str], score: str, later: str) -> DataFrame:
    """One row a key: the highest score, ties to the later row."""
    value = F.struct(F.col(score), F.col(later), F.struct(*(c for c in rows.columns if c not in keys)).alias("row"))
    return rows.groupBy(*keys).agg(F.max_by(value["row"], F.struct(value[score], value[later])).alias("row")).select(*keys, "row.*")


def union_distinct(first: DataFrame, second: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows of both, one for each key: those of ``first`` before those of ``second``, then by ``order``."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(key).orderBy("_side", order))
    return both.withColumn("_n", best).filter("_n = 1").drop("_side", "_n")


def best_relations(edges: DataFrame, kind: str = "type", confidence: str = "confidence") -> DataFrame:
    """One row for each (source, type, target), with its greatest confidence and how often it was found."""
    return edges.groupBy("source", kind, "target").agg(F.max(confidence).alias(confidence), F.count("*").alias("n_found"))


def merge_graph(nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Nodes (or edges) after an idempotent merge: known ones stay as they are, new ones come once."""
    return nodes.unionByName(found.dropDuplicates([key]).join(nodes.select(key), key, "left_anti").select(nodes.columns))


def running_total(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("running", F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with their index from 0 within a group."""
    return rows.withColumn("subchunk", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def job_states(logs: DataFrame, job: str, step: str, at: str, status: str) -> DataFrame:
    """One row a job and step: its latest state, when it began and how many seconds it took (null while it runs)."""
    done = F.max(F.when(F.col(status).isin("succeeded", "failed"), F.col(at)))
    began = F.min(F.when(F.col(status) == "running", F.col(at)))
    return logs.groupBy(job, step).agg(F.max_by(F.col(status), F.col(at)).alias("state"), began.alias("began"), (done.cast("double") - began.cast("double")).alias("seconds"))
