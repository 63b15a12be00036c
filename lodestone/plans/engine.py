"""The retrieval service as one object over Parquet tables: upload, chunk, search, rerank, memory, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, artifacts, chunking, context, conversation, relational, retrieval
from ..sources import files

#: Tables and their columns.
TABLES = {
    "files": "document_id string, filename string, file_size long, path string",
    "chunks": "chunk_id string, document_id string, chunk_index long, content string",
    "artifacts": "artifact_id string, chunk_id string, artifact_type string, canonical_text string, confidence double",
    "memories": "id long, user_id string, content string, is_active boolean",
    "retrieval_log": "query string, kind string, chunk_id string, rank long, score double",
}
_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


class Engine:
    """Tables live below ``root``, any folder that Spark reaches. Reads see what earlier calls wrote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def where(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        """A table's rows; none before its first write."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.where(name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self.where(name))

    # Ingestion

    def upload(self, folder: str) -> DataFrame:
        """Take new files of a folder (by name and size), cut them into chunks and compile their identifiers.

        Returns the new files' rows. What is taken is fixed before anything is written.
        """
        raw = files.raw_files(self.spark, folder).withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("file_size", F.col("length"))
        new = relational.unseen_uploads(raw.select("filename", "file_size", "path"), self.table("files"))
        new = new.withColumn("document_id", T.name_uuid(_NAMESPACE, F.concat_ws(":", "filename", F.col("file_size").cast("string")))).select("document_id", "filename", "file_size", "path")
        rows = self.spark.createDataFrame(new.collect(), TABLES["files"])  # one row a file, as the caller gets it
        contents = raw.select("path", "content").join(F.broadcast(rows.select("path", "document_id")), "path") if rows.count() < 10_000 else raw.select("path", "content").join(rows.select("path", "document_id"), "path")
        texts = contents.select("document_id", _decoded("content").alias("text"))
        files.append(self.chunked(texts), self.where("chunks"))
        fresh = self.table("chunks").join(rows.select("document_id"), "document_id", "left_semi")
        files.append(artifacts.compile_identifiers(fresh, "chunk_id", "content").select(*(c.split()[0] for c in TABLES["artifacts"].split(", "))), self.where("artifacts"))
        files.append(rows, self.where("files"))
        return rows

    def chunked(self, texts: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
        cut = chunking.split(texts, size, overlap, key="document_id")
        name = F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"), T.content_hash(F.col("chunk")))
        return cut.select(T.name_uuid(_NAMESPACE, name).alias("chunk_id"), "document_id", "chunk_index", F.col("chunk").alias("content"))

    # Search

    def scoped(self, scope: DataFrame | None) -> DataFrame:
        return retrieval.within(self.table("chunks"), scope, "document_id")

    def sparse(self, query: str, k: int = 10, scope: DataFrame | None = None) -> DataFrame:
        scores = retrieval.sparse_scores(self.scoped(scope), query, "chunk_id", "content")
        return retrieval.ranked(scores, k, F.desc("score"), F.col("chunk_id")).select("chunk_id", "rank", "score")

    def keyword(self, query: str, k: int = 10, scope: DataFrame | None = None, phrases: Sequence[str] = ()) -> DataFrame:
        terms = self.spark.range(1).select(T.content_tokens(F.lit(query)).alias("t")).first()["t"]
        if not terms and not phrases:
            return self.spark.createDataFrame([], "chunk_id string, rank long, score double")
        found = retrieval.keyword_scores(self.scoped(scope), terms or [""], phrases, "content")
        return retrieval.ranked(found, k, F.desc("n_exact"), F.desc("score"), F.col("chunk_id")).select("chunk_id", "rank", "score")

    def hybrid(self, query: str, k: int = 10, scope: DataFrame | None = None) -> DataFrame:
        """Both lists, three times k deep, fused; boosts see the content."""
        fused = retrieval.fuse(self.sparse(query, 3 * k, scope), self.keyword(query, 3 * k, scope), "chunk_id")
        full = retrieval.hydrate(fused, self.scoped(scope), "chunk_id", "fused")
        terms = self.spark.range(1).select(T.content_tokens(F.lit(query)).alias("t"), F.regexp_extract_all(F.lit(query), F.lit(T.NUMBER), F.lit(0)).alias("c")).first()
        scored = full.withColumn("score", F.col("fused") + retrieval.boosts(F.col("content"), terms["t"], terms["c"]))
        return retrieval.top(scored, k, F.desc("score"), F.col("chunk_id"))

    def rerank(self, query: str, k: int = 5, candidates: int = 20, scope: DataFrame | None = None) -> DataFrame:
        """Hybrid candidates ordered by the share of the query's tokens, then by their fused score; logged."""
        tokens = self.spark.range(1).select(T.content_tokens(F.lit(query)).alias("t")).first()["t"]
        found = self.hybrid(query, candidates, scope).withColumnRenamed("score", "hybrid").withColumn("score", retrieval.overlap_score(tokens, F.col("content")))
        best = retrieval.ranked(found, k, F.desc("score"), F.desc("hybrid"), F.col("chunk_id"))
        files.append(best.select(F.lit(query).alias("query"), F.lit("rerank").alias("kind"), "chunk_id", "rank", F.col("score").cast("double").alias("score")), self.where("retrieval_log"))
        return best.select("chunk_id", "document_id", "rank", "score", "content")

    def context(self, query: str, budget: int = 6000, k: int = 8) -> DataFrame:
        """The reranked chunks without repeated contents, while they fit the budget, numbered from 1."""
        best = self.rerank(query, k)
        kept = context.dedupe(best.withColumn("order", F.col("rank")), "order", "content").select(F.col("order").alias("rank"))
        rows = best.join(kept, "rank").withColumn("all", F.lit(0)).withColumn("n_chars", F.length("content"))
        fit = context.within_budget(rows, "all", "n_chars", budget, F.col("rank"))
        return relational.latest(fit, "all", k, F.col("rank")).select(F.col("n").alias("citation"), "chunk_id", "document_id", "content")

    def facts(self, terms: Sequence[str], least: float = 0.5, k: int = 10) -> DataFrame:
        return artifacts.search(self.table("artifacts"), terms, least, k)

    # Access, documents, memory

    def allowed(self, resources: DataFrame, subject: access.Subject) -> DataFrame:
        """Document ids that a subject may see; give it as a search's scope."""
        return access.visible(resources, subject).select("document_id")

    def documents(self, limit: int = 20, offset: int = 0) -> DataFrame:
        counts = self.table("chunks").groupBy("document_id").agg(F.count("*").alias("n_chunks"))
        rows = relational.listing(self.table("files"), "document_id", counts).fillna(0, ["n_chunks"])
        return relational.page(rows, limit, offset, F.col("filename"), F.col("document_id"))

    def delete(self, document_id: str) -> None:
        """Drop a document from every table: the rest is written beside it, then takes its place."""
        for name, key in (("artifacts", None), ("chunks", "document_id"), ("files", "document_id")):
            rows = self.table(name)
            mine = self.table("chunks").filter(F.col("document_id") == document_id).select("chunk_id")
            rest = rows.join(mine, "chunk_id", "left_anti") if key is None else rows.filter(F.col(key) != document_id)
            rest.write.mode("overwrite").parquet(self.where(f"_{name}_new"))
            self.spark.read.schema(TABLES[name]).parquet(self.where(f"_{name}_new")).write.mode("overwrite").parquet(self.where(name))

    def remember(self, user: str, content: str) -> None:
        last = self.table("memories").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        files.append(self.spark.createDataFrame([(last + 1, user, content, True)], TABLES["memories"]), self.where("memories"))

    def memories(self, user: str, needle: str = "", limit: int = 20) -> DataFrame:
        """Active memories of a user that contain the needle, newest first; a later row of an id replaces it."""
        rows = self.table("memories").groupBy("id", "user_id", "content").agg(F.bool_and("is_active").alias("is_active"))
        mine = rows.filter((F.col("user_id") == user) & F.col("is_active"))
        return relational.page(conversation.search_memory(mine, "content", needle), limit, 0, F.desc("id"))

    def forget(self, user: str, memory: int) -> None:
        """Soft delete: an inactive row for the same id."""
        gone = self.table("memories").filter((F.col("user_id") == user) & (F.col("id") == memory)).select("id", "user_id", "content", F.lit(False).alias("is_active"))
        files.append(self.spark.createDataFrame(gone.collect(), TABLES["memories"]), self.where("memories"))


def _decoded(column: str):
    """UTF-8 without its mark, Latin-1 where the bytes are no UTF-8."""
    plain = F.when(F.is_valid_utf8(F.col(column).cast("string")), F.decode(column, "UTF-8")).otherwise(F.decode(column, "ISO-8859-1"))
    return F.ltrim(F.regexp_replace(plain, "^\\x{FEFF}", ""))
