"""Queries over evidence keys, the answer cache, cues and folded findings."""

from pyspark.sql import functions as F

from corpusloom.functions import scan_rules as R
from corpusloom.operators import graph as G
from corpusloom.operators import scan as S
from corpusloom.operators import search as H
from corpusloom.operators import segment
from corpusloom.plans.inputs import sql, table
from corpusloom.plans.registry import query
from corpusloom.plans.scan_queries import PAGES, SCORE, edges, rules_sql


@query("evidence_keys", "SELECT doc_id, substr(sha256(concat_ws(chr(31), source, CAST(doc_id AS VARCHAR), text)), 1, 24) AS key FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", H.evidence_key(F.col("source"), F.col("doc_id"), F.col("text")).alias("key"))


ASKED = "SELECT event_id, 'What is the limit of unit ' || (event_id % 5) || '?' AS stored, CASE event_id % 3 WHEN 0 THEN ' what IS the  limit of unit ' || (event_id % 5) || '?' WHEN 1 THEN 'Limit of unit ' || (event_id % 5) ELSE 'What is not the limit of unit ' || (event_id % 5) || '?' END AS asked FROM events"


@query("same_question", "SELECT event_id, event_id % 3 = 0 OR event_id % 3 = 1 AS same FROM events")
def _(spark, d):
    return sql(spark, d, ASKED).select("event_id", H.same_question(F.trim("stored"), F.trim("asked"), 0.95).alias("same"))


@query("usable_answers", "SELECT DISTINCT o_orderkey AS entry_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 = 0)")
def _(spark, d):
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id")).distinct()
    li = table(spark, d, "lineitem")
    sources = li.select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("document_id"), F.lit("a").alias("fingerprint"))
    current = li.select(F.col("l_partkey").alias("document_id"), F.when(F.col("l_partkey") % 50 == 0, "b").otherwise("a").alias("fingerprint")).distinct()
    return H.usable_answers(entries, sources, current)


@query("webvtt")
def _(spark, d):
    return segment.webvtt(table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") * 7).alias("start"), (F.col("turn") * 7 + 5).alias("end"), "text"))


@query("normalize_ocr")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", segment.normalize_ocr(F.col("text")).alias("text"))


@query("apply_suppressions", f"WITH pages_ AS ({PAGES}), h AS (SELECT * FROM {rules_sql(R.INJECTION_PATTERNS)} WHERE name <> 'jailbreak_mention') {SCORE}")
def _(spark, d):
    muted = spark.createDataFrame([("jailbreak_mention",)], "name string")
    return S.apply_suppressions(S.rule_hits(sql(spark, d, PAGES), R.INJECTION_PATTERNS), muted)


@query("summarize_documents", f"""WITH pages_ AS ({PAGES}), h AS {rules_sql(R.INJECTION_PATTERNS)}, s AS ({SCORE}), own AS (SELECT document_id, page_id AS id FROM pages_),
  p AS (SELECT id, bool_or(severity = 'high' AND category <> 'meta_injection') AS high FROM h GROUP BY 1),
  a AS (SELECT document_id, max(score) AS max_score, count(*) AS flagged_pages, count(*) FILTER (WHERE high) AS high_pages FROM own JOIN p USING (id) JOIN s USING (id) GROUP BY 1),
  b AS (SELECT document_id, count(DISTINCT CASE WHEN severity = 'high' AND category <> 'meta_injection' THEN category END) AS high_categories, count(DISTINCT CASE WHEN category <> 'meta_injection' THEN category END) AS categories FROM own JOIN h USING (id) GROUP BY 1),
  l AS (SELECT d.document_id, max_score, flagged_pages, high_categories, CASE WHEN max_score IS NULL THEN 'none' WHEN max_score >= 0.8 OR high_categories >= 2 OR high_pages >= 3 THEN 'high' WHEN high_categories >= 1 OR (max_score >= 0.7 AND categories >= 2) THEN 'medium' ELSE 'low' END AS level
    FROM (SELECT DISTINCT document_id FROM pages_) d LEFT JOIN a USING (document_id) LEFT JOIN b USING (document_id))
  SELECT document_id, level, level IN ('medium', 'high') AS review, coalesce(max_score, 0.0)::DOUBLE AS max_score, coalesce(flagged_pages, 0) AS flagged_pages, coalesce(high_categories, 0) AS high_categories FROM l""")
def _(spark, d):
    p = sql(spark, d, PAGES)
    return S.summarize_documents(S.rule_hits(p, R.INJECTION_PATTERNS), p)


@query("eigenvector")
def _(spark, d):
    return G.eigenvector(G.undirected(edges(spark, d, 4))).withColumn("centrality", F.round("centrality", 6))
