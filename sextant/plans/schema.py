"""The stored tables: schemas, defaults and checks before rows are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "collections": "id string, name string, description string, inserted_at timestamp, updated_at timestamp",
    "documents": "id string, content string, content_type string, source_id string, file_path string, metadata map<string,string>, status string, error string, chunk_count int, collection_id string, inserted_at timestamp, updated_at timestamp",
    "chunks": "id string, text string, embedding array<float>, chunk_index int, token_count int, metadata map<string,string>, document_id string",
    "entities": "id string, name string, name_key string, type string, description string, embedding array<float>, metadata map<string,string>, chunk_id string, collection_id string",
    "mentions": "id string, entity_id string, chunk_id string, span_start int, span_end int, context string",
    "relationships": "id string, source_id string, target_id string, type string, description string, strength int, metadata map<string,string>",
    "communities": "id string, level int, description string, summary string, entity_ids array<string>, dirty boolean, change_count int, summary_fingerprint string, collection_id string",
    "test_cases": "id string, question string, source string, reference_answer string, source_chunk_id string",
    "test_case_chunks": "test_case_id string, chunk_id string",
    "runs": "id string, status string, metrics map<string,double>, results string, config map<string,string>, test_case_count int, inserted_at timestamp",
}
UNIQUE = {"collections": ["name"], "entities": ["name_key", "collection_id"], "mentions": ["entity_id", "chunk_id"], "test_case_chunks": ["test_case_id", "chunk_id"]}
STATUSES = ("pending", "processing", "completed", "failed")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def problems(name: str, rows: DataFrame, dimensions: int | None = None) -> DataFrame:
    """problem, n: rows that the table can't hold, counted by what is wrong; no rows if all is well."""
    tests = {}
    if name == "documents":
        tests["unknown status"] = ~F.coalesce(F.col("status"), F.lit("pending")).isin(*STATUSES)
    if name == "chunks":
        tests["no text"] = F.col("text").isNull()
        tests["no embedding"] = F.col("embedding").isNull()
        if dimensions:
            tests["other dimension"] = F.size("embedding") != dimensions
    if name == "relationships":
        tests["strength outside 1 to 10"] = F.col("strength").isNotNull() & ~F.col("strength").between(1, 10)
    if name == "communities":
        tests["negative level"] = F.col("level") < 0
    if not tests:
        return rows.sparkSession.createDataFrame([], "problem string, n long")
    counts = rows.agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()))
    return counts.select(F.explode(F.create_map(*(x for k in tests for x in (F.lit(k), F.col(f"`{k}`"))))).alias("problem", "n")).where("n > 0")
