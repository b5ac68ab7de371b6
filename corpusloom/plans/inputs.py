"""The inputs of the registered queries: the driver's tables, and the engine's data model as views of them.

The SQL of the views runs unchanged on Spark and on DuckDB, so a query and its SQL twin start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps",
)

#: Documents of the data model: one row each with name, format, size, policy status and replaced-by pointer.
DOCS = """SELECT d.doc_id AS document_id,
  'file' || d.doc_id || CASE d.doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.CSV' WHEN 2 THEN '.txt' WHEN 3 THEN '.pdf' ELSE '' END AS filename,
  CASE d.doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'CSV' WHEN 2 THEN 'txt' ELSE 'pdf' END AS source_format,
  d.doc_id % 7 AS num_pages, d.doc_id % 4 AS num_chunks,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.n_chars END AS file_size,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE d.lang END AS source_type,
  '2026-0' || (1 + d.doc_id % 9) || '-1' || (d.doc_id % 10) || 'T00:00:00' AS uploaded_at,
  CASE WHEN l.toxic = 1 THEN 'quarantined' WHEN l.quality = 0 THEN 'flagged' ELSE NULL END AS policy_status,
  CASE WHEN d.doc_id % 13 = 0 THEN 1 ELSE 0 END AS local_only,
  CASE WHEN d.doc_id % 10 = 3 THEN d.doc_id - 1 WHEN d.doc_id % 50 = 7 THEN -1 END AS superseded_by,
  CASE d.doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'confidential' END AS sensitivity,
  md5(d.text) AS content_hash, d.source AS collection_id, d.text AS text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

#: Chunks (passages): ten to a document.
CHUNKS = """SELECT doc_id AS chunk_id, CAST(floor(doc_id / 10) AS BIGINT) AS document_id, CAST(floor((doc_id % 10) / 3) AS BIGINT) AS page_number,
  doc_id % 10 AS chunk_index, text, lang FROM documents"""

#: Entity mentions: runs of a capital and two or more small letters in a chunk.
ENTITIES = {
    "spark": "SELECT DISTINCT doc_id AS chunk_id, lower(e) AS entity FROM (SELECT doc_id, explode(regexp_extract_all(text, '[A-Z][a-z]{2,}', 0)) AS e FROM documents)",
    "duckdb": "SELECT DISTINCT doc_id AS chunk_id, lower(e) AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}', 0)) AS e FROM documents)",
}


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the driver's tables; those that the text names are registered first."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DOCS)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CHUNKS)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, ENTITIES["spark"])


def over(sql_text: str) -> str:
    """SQL for DuckDB with the data model's views in front."""
    return f"WITH docs AS ({DOCS}), chunks AS ({CHUNKS}), entities AS ({ENTITIES['duckdb']}) {sql_text}"
