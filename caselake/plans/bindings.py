"""The driver tables in the roles of the case corpus, in Spark and, for the oracles, in SQL.

cases and case_texts are documents (labels give the outcome); chunks and vectors are embeddings, five to a case; queries
are the benchmark's items, with a word or two of their texts and a vector; versions are conversations' turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; results of its queries are read under the Arrow batches set here."""
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    rows = docs.join(labels, "doc_id", "left").select(
        i.alias("case_id"), F.format_string("D%08d", i).alias("case_number"), (100 + i % 15).cast("int").alias("roc_year"),
        F.format_string("%03d.%02d.%02d", 100 + i % 15, 1 + i % 12, 1 + i % 28).alias("decision_date"), F.col("lang").alias("decision_category"),
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("decision_result"), F.col("source").alias("dispute_type"), "text", "n_chars",
    )
    return rows if text else rows.drop("text", "n_chars")


CASES = """cases AS (SELECT d.doc_id AS case_id, 'D' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS case_number, CAST(100 + d.doc_id % 15 AS INTEGER) AS roc_year,
 lpad(CAST(100 + d.doc_id % 15 AS VARCHAR), 3, '0') || '.' || lpad(CAST(1 + d.doc_id % 12 AS VARCHAR), 2, '0') || '.' || lpad(CAST(1 + d.doc_id % 28 AS VARCHAR), 2, '0') AS decision_date,
 d.lang AS decision_category, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END AS decision_result, d.source AS dispute_type, d.text, d.n_chars
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(i.alias("chunk_id"), F.floor(i / 5).alias("case_id"), (i % 5).cast("int").alias("chunk_index"), F.col("embedding").alias("vector"), F.col("label").alias("dispute_type"))


CHUNKS = "chunks AS (SELECT vec_id AS chunk_id, vec_id // 5 AS case_id, CAST(vec_id % 5 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS vector, label AS dispute_type FROM embeddings)"


def dated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).drop("dispute_type").join(cases(spark, sf_dir).select("case_id", "decision_date", "case_number"), "case_id")


DATED = "dated AS (SELECT k.*, c.decision_date, c.case_number FROM chunks k JOIN cases c USING (case_id))"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query (the fourth word of the item), words (its fourth and fifth)."""
    w = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.get(w, 3).alias("query"), F.concat_ws(" ", F.get(w, 3), F.get(w, 4)).alias("words")).where("query is not null and query != ''")


QUERIES = "queries AS (SELECT * FROM (SELECT item_id AS query_id, string_split(text, ' ')[4] AS query, concat_ws(' ', string_split(text, ' ')[4], string_split(text, ' ')[5]) AS words FROM benchmark) WHERE query IS NOT NULL AND query <> '')"


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector: the vectors with an id divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select((F.col("vec_id") / 20).cast("bigint").alias("query_id"), F.col("embedding").alias("vector"))


QUERY_VECTORS = "qv AS (SELECT vec_id // 20 AS query_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id % 20 = 0)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary versions: a conversation is a case, a turn a version."""
    t, c = F.col("turn"), F.col("conv_id")
    status = F.when((c + t) % 4 == 0, "approved").when((c + t) % 4 == 1, "rejected").otherwise("unreviewed")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", c, t).alias("summary_id"), c.alias("case_id"), status.alias("review_status"),
        F.format_string("2025-01-%02dT00:00:00", 1 + (t * 7 + c) % 28).alias("generated_at"), F.format_string("2025-02-%02dT00:00:00", 1 + t % 28).alias("imported_at"),
    )


VERSIONS = """versions AS (SELECT concat_ws('_', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS summary_id, conv_id AS case_id,
 CASE WHEN (conv_id + turn) % 4 = 0 THEN 'approved' WHEN (conv_id + turn) % 4 = 1 THEN 'rejected' ELSE 'unreviewed' END AS review_status,
 '2025-01-' || lpad(CAST(1 + (turn * 7 + conv_id) % 28 AS VARCHAR), 2, '0') || 'T00:00:00' AS generated_at,
 '2025-02-' || lpad(CAST(1 + turn % 28 AS VARCHAR), 2, '0') || 'T00:00:00' AS imported_at FROM conversations)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
