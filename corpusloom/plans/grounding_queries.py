"""Queries over grounding and bibliography."""

from pyspark.sql import functions as F

from corpusloom.operators import bibliography as B
from corpusloom.operators import grounding as G
from corpusloom.plans.inputs import sql, table
from corpusloom.plans.registry import query


@query("sentence_overlap", "WITH k AS (SELECT n.doc_id, list_distinct([w FOR w IN regexp_extract_all(lower(d.text), '[a-z0-9]{3,}') IF w NOT IN (" + ",".join(f"'{w}'" for w in G.STOPWORDS) + ")]) AS k, ' ' || regexp_replace(lower(n.text), '[^a-z0-9]+', ' ', 'g') AS t FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1) SELECT doc_id, round(CASE WHEN len(k) < 4 THEN 0 ELSE len([w FOR w IN k IF contains(t, ' ' || w)]) / len(k) END, 6) AS share FROM k")
def _(spark, d):
    x = table(spark, d, "documents")
    claims = x.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("claim"))
    return x.select("doc_id", "text").join(claims, "doc_id").select("doc_id", F.round(G.overlap(F.col("claim"), F.col("text")), 6).alias("share"))


@query("quote_differences", "SELECT event_id, list_sort(['must', CAST(event_id + 1 AS VARCHAR)]) AS d FROM events")
def _(spark, d):
    x = table(spark, d, "events")
    return x.select("event_id", G.differences(F.lit("a"), F.concat(F.lit("must "), (F.col("event_id") + 1).cast("string"))).alias("d"))


@query("verify_quotes")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", -1).alias("quote"), F.col("text").alias("passage"))
    return x.select("doc_id", G.quote_verdict("quote", "passage").alias("verdict"))


@query("check_answers")
def _(spark, d):
    x = table(spark, d, "events").select("event_id", F.concat(F.lit("It took "), F.col("event_id").cast("string"), F.lit(" s [1]. Then it ended.")).alias("a"), F.array(F.lit("it took 7 s")).alias("p"))
    return x.select("event_id", F.inline(G.checked_answers("a", "p")))


@query("suggest_filenames", "SELECT doc_id, substr(regexp_replace('2024 - Smith et al - ' || split_part(text, chr(10), 1), '[\\\\/:*?\"<>|]', '', 'g'), 1, 120) AS name FROM documents")
def _(spark, d):
    authors = F.array(F.lit("Ann Smith"), F.lit("B. C."), F.lit("D E"))
    return table(spark, d, "documents").select("doc_id", B.suggest_filename(F.lit(2024), authors, F.substring_index("text", "\n", 1)).alias("name"))


@query("reference_entries", "SELECT doc_id AS document_id, unnest([0, 1]) AS k, unnest(['first ' || doc_id, 'second entry']) AS entry FROM documents")
def _(spark, d):
    x = sql(spark, d, "SELECT doc_id AS document_id, concat('body\nReferences\n[1] first ', doc_id, '\n[2] second\n entry\n') AS text FROM documents")
    return B.entries(x)
