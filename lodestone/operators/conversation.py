"""Query classification, memory and session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cues of question kinds, tried in this order.
CUES = {"compare": ("compare", "difference", "versus"), "count": ("how many", "count", "number of"), "list": ("list", "which", "all of"), "procedure": ("how to", "steps", "procedure"), "definition": ("what is", "define", "meaning")}


def strategy(text: Column) -> Column:
    """The first kind whose cue occurs; short cues need word boundaries."""
    low, out = F.lower(text), None
    for kind, cues in CUES.items():
        hit = F.lit(False)
        for cue in cues:
            hit = hit | (low.rlike(rf"\b{cue}\b") if len(cue) <= 5 else F.contains(low, F.lit(cue)))
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("general"))


def scope(text: Column) -> Column:
    """Small talk, identifier lookup, or a question to documents."""
    low = F.trim(F.lower(text))
    return F.when(low.rlike(r"^(hi|hello|thanks|thank you|bye)\b"), "smalltalk").when(low.rlike(r"\b\d{2,8}\b|\b\d+/[a-z]"), "identifier_lookup").when(F.length(low) == 0, "out_of_scope").otherwise("document_question")


def last_messages(turns: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each session, in order, as one text."""
    newest = turns.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).filter(F.col("_n") <= n)
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.concat("role", F.lit(": "), "text").alias("said")))), lambda x: x["said"])
    return newest.groupBy(session).agg(F.array_join(said, "\n").alias("context"), F.count("*").alias("n_messages"))


def due_for_summary(turns: DataFrame, every: int, session: str = "conv_id") -> DataFrame:
    return turns.groupBy(session).agg(F.count("*").alias("n_messages")).filter(F.col("n_messages") % every == 0)


def search_memory(rows: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows that contain the needle in either case; its characters are taken literally."""
    return rows.filter(F.contains(F.lower(text), F.lit(needle.lower())))
