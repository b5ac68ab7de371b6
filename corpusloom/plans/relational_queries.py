"""Queries over joins, aggregations, ranking and mutations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import aggregates as A
from corpusloom.operators import joins as J
from corpusloom.operators import mutations as M
from corpusloom.operators import ranking as R
from corpusloom.plans.inputs import chunks, docs, entities, over, sql, table
from corpusloom.plans.listing_queries import KEY, OPEN
from corpusloom.plans.registry import query


@query("servable_chunk_refs", over(f"SELECT chunk_id, document_id, filename FROM chunks JOIN docs USING (document_id) WHERE {OPEN}"))
def _(spark, d):
    return J.servable_chunk_refs(chunks(spark, d), docs(spark, d))


@query("supersede_info", over(f"SELECT d.document_id, d.superseded_by, t.filename AS replaced_by_name FROM docs d JOIN docs t ON t.document_id = d.superseded_by WHERE coalesce(t.policy_status,'clear') <> 'quarantined'"))
def _(spark, d):
    return J.supersede_info(docs(spark, d))


@query("replacement_names", over("""SELECT d.document_id, t.document_id AS superseded_by, t.filename AS replaced_by_name FROM docs d
  LEFT JOIN (SELECT * FROM docs WHERE coalesce(policy_status,'clear') <> 'quarantined') t ON t.document_id = d.superseded_by"""))
def _(spark, d):
    return J.with_replacement(docs(spark, d)).select("document_id", "superseded_by", "replaced_by_name")


@query("chunks_without_entities", over("SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM entities)"))
def _(spark, d):
    return J.without(chunks(spark, d), entities(spark, d), "chunk_id").select("chunk_id")


@query("orphan_labels", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def _(spark, d):
    return J.without(table(spark, d, "labels"), table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id").select("doc_id")


@query("entities_by_document", over("SELECT document_id, list_sort(list(DISTINCT entity)) AS entities FROM entities JOIN chunks USING (chunk_id) WHERE (page_number, chunk_index) < (1, 5) GROUP BY 1"))
def _(spark, d):
    stop = F.struct(F.lit(1).cast("long").alias("page_number"), F.lit(5).cast("long").alias("chunk_index"))
    return J.entities_by_document(entities(spark, d), chunks(spark, d), stop)


@query("chunks_by_entities", over("SELECT chunk_id, count(DISTINCT entity) AS shared FROM entities WHERE entity IN ('the','and','der','les','thand') GROUP BY 1 HAVING count(DISTINCT entity) >= 2 ORDER BY shared DESC, chunk_id LIMIT 25"))
def _(spark, d):
    return J.chunks_by_entities(entities(spark, d), ["the", "and", "der", "les", "thand"], 2)


REFS = """SELECT doc_id AS ref_id, CASE WHEN doc_id % 4 = 0 THEN '10.1000/' || (doc_id % 97) END AS doi, CASE WHEN doc_id % 4 = 1 THEN '2401.' || (doc_id % 89) END AS arxiv_id,
  lower(text) AS raw FROM documents"""
PAPERS = """SELECT doc_id AS paper_id, '10.1000/' || doc_id AS doi, '2401.' || doc_id AS arxiv_id, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)) AS title_key FROM documents"""


@query("match_references", f"""WITH refs AS ({REFS}), papers AS ({PAPERS}),
  f AS (SELECT ref_id, paper_id, 1 AS rank, 0 AS size FROM refs JOIN papers USING (doi) UNION ALL SELECT ref_id, paper_id, 2, 0 FROM refs JOIN papers USING (arxiv_id)
  UNION ALL SELECT ref_id, paper_id, 3, length(title_key) FROM refs JOIN papers ON contains(raw, title_key)
    AND contains(' ' || raw || ' ', ' ' || title_key || ' ') WHERE length(title_key) >= 20)
  SELECT ref_id, paper_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rank, size DESC, paper_id) AS k FROM f) WHERE k = 1""")
def _(spark, d):
    refs, papers = sql(spark, d, REFS), sql(spark, d, PAPERS)
    return J.match_references(refs, papers)


for _fn in ("sum", "mean", "count", "min", "max"):
    _f = {"mean": "avg"}.get(_fn, _fn)
    query(f"aggregate_{_fn}", f"SELECT o_orderpriority AS grp, {'round(' + _f + '(o_totalprice), 4)' if _fn in ('sum', 'mean') else _f + '(o_totalprice)'} AS value FROM orders GROUP BY 1")(
        lambda spark, d, fn=_fn: A.aggregate_table(table(spark, d, "orders"), "o_totalprice", fn, "o_orderpriority", "value").withColumn("value", F.round("value", 4) if fn in ("sum", "mean") else F.col("value"))
    )


@query("aggregate_all_rows", "SELECT count(l_quantity) AS value FROM lineitem")
def _(spark, d):
    return A.aggregate_table(table(spark, d, "lineitem"), "l_quantity", "count")


@query("numeric_stats", """WITH v AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem)
  SELECT min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(sum(v), 2) AS sum, count(*) AS count,
  max(v) FILTER (WHERE k = CAST(round_even(0.25 * (n - 1), 0) AS BIGINT)) AS p25, max(v) FILTER (WHERE k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50,
  max(v) FILTER (WHERE k = CAST(round_even(0.75 * (n - 1), 0) AS BIGINT)) AS p75 FROM v""")
def _(spark, d):
    return A.numeric_stats(table(spark, d, "lineitem"), "l_extendedprice").withColumns({"mean": F.round("mean", 4), "sum": F.round("sum", 2)})


@query("lot_rollup", """SELECT coalesce(nullif(trim(l_returnflag || CASE WHEN l_linenumber = 7 THEN '' ELSE '-' || l_linenumber END), ''), 'x') AS position, round(sum(l_extendedprice), 2) AS l_extendedprice, sum(l_quantity) AS l_quantity,
  max(l_linestatus) AS l_linestatus, count(*) AS lots, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_cost FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("symbol", F.lit("  ")).withColumn("code", F.concat("l_returnflag", F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("-"), "l_linenumber"))))
    out = A.rollup(rows, ["symbol", "code"], ["l_extendedprice", "l_quantity"], ["l_linestatus"], "l_extendedprice", "l_quantity")
    return out.withColumns({"l_extendedprice": F.round("l_extendedprice", 2), "unit_cost": F.round("unit_cost", 6)})


@query("collection_stats", over("""SELECT count(*) AS documents, CAST(sum(num_pages) AS BIGINT) AS pages, CAST(sum(num_chunks) AS BIGINT) AS chunks, CAST(sum(file_size) AS BIGINT) AS bytes, min(uploaded_at) AS first, max(uploaded_at) AS last,
  count(*) FILTER (WHERE file_size IS NULL) AS no_size, count(*) FILTER (WHERE num_chunks = 0) AS no_chunks FROM docs"""))
def _(spark, d):
    return A.collection_totals(docs(spark, d))


@query("collection_extensions", over(f"SELECT {KEY} AS key, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM docs GROUP BY 1 ORDER BY n DESC, key LIMIT 10"))
def _(spark, d):
    return A.by_extension(docs(spark, d), 10)


@query("collection_by_sensitivity", over("SELECT coalesce(sensitivity, 'internal') AS label, count(*) AS n FROM docs GROUP BY 1"))
def _(spark, d):
    return docs(spark, d).groupBy(F.coalesce("sensitivity", F.lit("internal")).alias("label")).agg(F.count("*").alias("n"))


@query("collection_by_source_type", over("SELECT coalesce(source_type, 'upload') AS label, count(*) AS n FROM docs GROUP BY 1"))
def _(spark, d):
    return docs(spark, d).groupBy(F.coalesce("source_type", F.lit("upload")).alias("label")).agg(F.count("*").alias("n"))


@query("largest_documents", over("SELECT document_id, file_size FROM docs WHERE file_size IS NOT NULL ORDER BY file_size DESC, document_id LIMIT 5"))
def _(spark, d):
    return docs(spark, d).filter("file_size is not null").orderBy(F.desc("file_size"), "document_id").limit(5).select("document_id", "file_size")


@query("count_documents", over("SELECT count(*) AS n FROM docs WHERE contains(lower(filename), '.csv')"))
def _(spark, d):
    return docs(spark, d).filter(F.contains(F.lower("filename"), F.lit(".csv"))).agg(F.count("*").alias("n"))


@query("count_held_documents", over("SELECT count(*) AS n FROM docs WHERE policy_status = 'quarantined'"))
def _(spark, d):
    return docs(spark, d).filter("policy_status = 'quarantined'").agg(F.count("*").alias("n"))


@query("filter_facets", over("SELECT DISTINCT lower(source_format) AS format FROM docs"))
def _(spark, d):
    return docs(spark, d).select(F.lower("source_format").alias("format")).distinct().orderBy("format")


@query("entity_document_frequency", over("SELECT entity, count(*) AS df FROM entities GROUP BY 1"))
def _(spark, d):
    return entities(spark, d).groupBy("entity").agg(F.count("*").alias("df"))


@query("entity_corpus_filter", over("SELECT entity, count(*) AS df FROM entities GROUP BY 1 HAVING count(*) BETWEEN 2 AND greatest(2, CAST(floor((SELECT count(*) FROM chunks) * 0.3) AS BIGINT))"))
def _(spark, d):
    from corpusloom.operators.search import corpus_filter

    return corpus_filter(entities(spark, d), chunks(spark, d).count())


@query("corpus_token", over("""SELECT concat_ws(':', count(*), max(uploaded_at), CAST(sum(num_chunks) AS BIGINT), count(*) FILTER (WHERE policy_status = 'quarantined'), count(superseded_by)) AS token FROM docs"""))
def _(spark, d):
    return A.corpus_token(docs(spark, d))


@query("leading_text", over("SELECT document_id, substr(string_agg(text, ' ' ORDER BY chunk_index), 1, 6000) AS leading FROM chunks WHERE chunk_index < 3 GROUP BY 1"))
def _(spark, d):
    return A.leading_text(chunks(spark, d))


EV = "(SELECT event_id, ts, CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS user_id, event_type, value FROM events)"


@query("usage_by_user", f"""SELECT coalesce(CAST(user_id AS VARCHAR), 'anonymous') AS key, count(*) AS turns, round(sum(value), 4) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(ts) AS last_active
  FROM {EV} WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1""")
def _(spark, d):
    return A.usage_summary(sql(spark, d, f"SELECT * FROM {EV}"), "2024-01-02 00:00:00").withColumn("total", F.round("total", 4))


@query("usage_by_day", f"""SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) AS turns, round(sum(value), 4) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(ts) AS last_active
  FROM {EV} WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1""")
def _(spark, d):
    return A.usage_summary(sql(spark, d, f"SELECT * FROM {EV}"), "2024-01-02 00:00:00", "day").withColumn("total", F.round("total", 4))


@query("user_usage_null_safe", f"SELECT count(*) AS turns, round(sum(value), 4) AS total FROM {EV} WHERE user_id IS NOT DISTINCT FROM NULL AND ts >= TIMESTAMP '2024-01-01 00:00:00'")
def _(spark, d):
    e = sql(spark, d, f"SELECT * FROM {EV}")
    return e.filter(F.col("user_id").eqNullSafe(None) & (F.col("ts") >= "2024-01-01")).agg(F.count("*").alias("turns"), F.round(F.sum("value"), 4).alias("total"))


@query("daily_budget", "SELECT user_id, round(sum(value), 4) AS used, sum(value) >= 500 AS exceeded FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    today = F.broadcast(e.agg(F.date_trunc("day", F.max("ts")).alias("today")))  # one row
    return e.join(today, F.col("ts") >= F.col("today")).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("used"), (F.sum("value") >= 500).alias("exceeded"))


KINDS = "(SELECT '.md' AS key, 'text' AS kind UNION ALL SELECT '.txt', 'text' UNION ALL SELECT '.csv', 'table')"


@query("kind_counts", over(f"SELECT coalesce(kind, 'other') AS kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {KEY} AS key, count(*) AS n FROM docs GROUP BY 1) LEFT JOIN {KINDS} USING (key) GROUP BY 1"))
def _(spark, d):
    from corpusloom.operators.listing import extension_key

    keys = docs(spark, d).groupBy(extension_key(F.col("filename")).alias("key")).agg(F.count("*").alias("n"))
    return A.kind_counts(keys, spark.sql(f"SELECT * FROM {KINDS}"))


@query("linear_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("duration_histogram", "SELECT event_type, len([b FOR b IN [1.0, 5.0, 20.0, 50.0, 100.0] IF b < value])::INT AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return A.token_histogram(table(spark, d, "events"), "value", [1.0, 5.0, 20.0, 50.0, 100.0], "event_type")


@query("named_counters", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))


@query("brief_counts", over("SELECT collection_id, count(*) AS briefs, count(*) FILTER (WHERE policy_status IS NULL) AS unread FROM docs GROUP BY 1"))
def _(spark, d):
    return docs(spark, d).groupBy("collection_id").agg(F.count("*").alias("briefs"), F.count_if(F.col("policy_status").isNull()).alias("unread"))


@query("reviewed_documents", over("SELECT DISTINCT document_id FROM docs WHERE num_chunks = 2 AND coalesce(source_type, '') = ''"))
def _(spark, d):
    return docs(spark, d).filter((F.col("num_chunks") == 2) & (F.coalesce("source_type", F.lit("")) == "")).select("document_id").distinct()


HITS = "(SELECT doc_id AS id, round(1.0 / (1 + doc_id % 17), 4)::DOUBLE AS score, doc_id % 10 = 3 AS superseded FROM documents)"


@query("demote_superseded", f"SELECT id, round(CASE WHEN superseded THEN greatest(0, score - 0.15) ELSE score END, 4) AS score, row_number() OVER (ORDER BY round(CASE WHEN superseded THEN greatest(0, score - 0.15) ELSE score END, 4) DESC, id) AS rank FROM {HITS}")
def _(spark, d):
    hits = sql(spark, d, f"SELECT * FROM {HITS.replace('::DOUBLE', '')}").withColumn("score", F.col("score").cast("double"))
    return R.ranked(R.demote_superseded(hits).withColumn("score", F.round("score", 4)), "score", "id").select("id", "score", "rank")


@query("merge_collections", over("SELECT document_id, num_pages AS similarity FROM docs WHERE collection_id IN ('src1','src2','src3') ORDER BY num_pages DESC, document_id LIMIT 20"))
def _(spark, d):
    x = docs(spark, d).select("document_id", "collection_id", F.col("num_pages").alias("similarity"), F.when(F.col("collection_id") == "src1", F.col("num_pages")).alias("rerank"))
    return R.merge_collections([x.filter(F.col("collection_id") == c) for c in ("src1", "src2", "src3")], 20, "document_id").select("document_id", "similarity")


@query("first_rank", "SELECT grp, min(rank) AS rank FROM (SELECT label AS grp, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) WHERE vec_id IN (SELECT item_id * 7 FROM benchmark) GROUP BY 1")
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    results = table(spark, d, "embeddings").select(F.col("label").alias("grp"), "vec_id", rank.alias("rank"))
    return R.first_rank(results, table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("vec_id")), "grp", "vec_id")


@query("quick_rank", over("SELECT document_id FROM docs ORDER BY CASE policy_status WHEN 'flagged' THEN 0 WHEN 'quarantined' THEN 2 ELSE 1 END, num_pages DESC, num_chunks DESC, document_id LIMIT 30"))
def _(spark, d):
    order = F.when(F.col("policy_status") == "flagged", 0).when(F.col("policy_status") == "quarantined", 2).otherwise(1)
    return docs(spark, d).orderBy(order, F.desc("num_pages"), F.desc("num_chunks"), "document_id").limit(30).select("document_id")


@query("review_rank", over("""SELECT document_id, greatest(CASE WHEN policy_status = 'quarantined' THEN 90 ELSE 0 END, CASE WHEN policy_status = 'flagged' THEN 60 + CAST(floor(9 * num_pages / 7.0) AS INT) ELSE 0 END,
  CASE WHEN num_chunks = 3 THEN 70 + least(num_pages, 5) ELSE 0 END, CASE WHEN local_only = 1 THEN 55 ELSE 0 END) AS rank FROM docs"""))
def _(spark, d):
    x = docs(spark, d).select("document_id", F.lit(False).alias("critical"), (F.col("policy_status") == "quarantined").alias("held"), F.when(F.col("policy_status") == "flagged", F.col("num_pages") / 7).alias("policy_score"),
                              F.when(F.col("num_chunks") == 3, F.col("num_pages")).alias("reports"), F.when(F.col("local_only") == 1, "high").alias("injection"))
    return x.select("document_id", R.review_rank().cast("long").alias("rank"))


@query("per_source_related", "WITH p AS (SELECT o_custkey % 50 AS doc, o_orderkey AS passage, o_orderpriority AS other, max(o_totalprice) AS score FROM orders GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY doc, other ORDER BY score DESC, passage) AS k FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, passage) AS r FROM a WHERE k <= 2) SELECT doc, other, passage, score FROM b WHERE r <= 6")
def _(spark, d):
    pairs = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("doc"), F.col("o_orderkey").alias("passage"), F.col("o_orderpriority").alias("other"), F.col("o_totalprice").alias("score"))
    return R.per_source(pairs)


@query("ring_buffer", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 50")
def _(spark, d):
    return R.last_of_each(table(spark, d, "events"), "user_id", "event_id", 50).select("user_id", "event_id")


NEW = "(SELECT doc_id, text || ' new' AS text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id < 10)"


@query("upsert_chunks", f"SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {NEW}) UNION ALL SELECT doc_id, text FROM {NEW}")
def _(spark, d):
    return M.upsert(table(spark, d, "documents").select("doc_id", "text"), sql(spark, d, f"SELECT * FROM {NEW}"), "doc_id")


@query("delete_documents", over("SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT item_id FROM benchmark)"))
def _(spark, d):
    gone = table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"))
    return M.delete(chunks(spark, d), gone, "document_id").select("chunk_id")


@query("cascade_clear_pointers", over("SELECT document_id, CASE WHEN superseded_by IN (SELECT item_id FROM benchmark) THEN NULL ELSE superseded_by END AS superseded_by FROM docs WHERE document_id NOT IN (SELECT item_id FROM benchmark)"))
def _(spark, d):
    gone = table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"))
    return M.clear_pointers(M.delete(docs(spark, d), gone, "document_id"), gone).select("document_id", "superseded_by")


@query("chunk_boosts", "SELECT doc_id AS chunk_id, CAST(greatest(-1, least(1, (doc_id % 9 - 4) / 3.0)) AS DOUBLE) AS boost FROM documents WHERE doc_id % 9 <> 4")
def _(spark, d):
    return M.boosts(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), ((F.col("doc_id") % 9 - 4) / F.lit(3.0)).alias("boost")))


@query("share_contacts", "WITH c AS (SELECT lower(trim(c_name)) AS address, c_custkey % 40 AS share FROM customer UNION SELECT lower(trim(s_name)), s_suppkey % 40 FROM supplier) SELECT address, count(DISTINCT share) AS shares FROM c GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "customer").select(F.lower(F.trim("c_name")).alias("address"), (F.col("c_custkey") % 40).alias("share"))
    b = table(spark, d, "supplier").select(F.lower(F.trim("s_name")).alias("address"), (F.col("s_suppkey") % 40).alias("share"))
    return M.contacts(a, b)


@query("active_shares", "SELECT count(DISTINCT o_orderkey) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' OR o_orderstatus = 'F'")
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").filter("c_mktsegment = 'BUILDING' or o_orderstatus = 'F'").agg(F.countDistinct("o_orderkey").alias("n"))


@query("shared_collections", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND o_totalprice > 100000")
def _(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.filter("o_totalprice > 100000").join(c, o.o_custkey == c.c_custkey).join(n.filter("n_regionkey = 1"), c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("share_access", "SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, d):
    order = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return R.best_of_each(table(spark, d, "orders"), "o_custkey", [order, F.col("o_orderkey")], "o_orderpriority")


@query("quota_check", over("SELECT collection_id, CAST(sum(file_size) AS BIGINT) AS used, sum(file_size) + 1000 > 100000 AS exceeded FROM docs GROUP BY 1"))
def _(spark, d):
    return docs(spark, d).groupBy("collection_id").agg(F.sum("file_size").alias("used"), (F.sum("file_size") + 1000 > 100000).alias("exceeded"))


@query("retention_sweep", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def _(spark, d):
    e = table(spark, d, "events")
    return M.sweep(e, "ts", e.agg(F.max("ts")).first()[0], 3).select("event_id")


SNAP = over("SELECT document_id, filename, content_hash, superseded_by FROM docs")


@query("snapshot_diff", over("""SELECT coalesce(n.id, p.id) AS id, coalesce(n.name, p.name) AS name,
  CASE WHEN p.id IS NULL AND q.name IS NOT NULL THEN 'replaced' WHEN p.id IS NULL THEN 'added' WHEN p.id % 10 = 3 THEN 'superseded' ELSE 'removed' END AS change
  FROM (SELECT document_id AS id, filename AS name FROM docs WHERE document_id < 60) p
  FULL JOIN (SELECT CASE WHEN document_id % 8 = 0 THEN document_id + 5000 ELSE document_id END AS id, filename AS name FROM docs WHERE document_id BETWEEN 20 AND 90) n ON n.id = p.id
  LEFT JOIN (SELECT filename AS name FROM docs WHERE document_id < 60) q ON q.name = n.name
  LEFT JOIN (SELECT filename AS name FROM docs WHERE document_id BETWEEN 20 AND 90) m ON m.name = p.name
  WHERE (p.id IS NULL OR n.id IS NULL) AND NOT (n.id IS NULL AND m.name IS NOT NULL)"""))
def _(spark, d):
    x = docs(spark, d).select(F.col("document_id").alias("id"), F.col("filename").alias("name"))
    now = x.filter("id between 20 and 90").withColumn("id", F.when(F.col("id") % 8 == 0, F.col("id") + 5000).otherwise(F.col("id")))
    return M.snapshot_diff(x.filter("id < 60"), now, x.filter("id % 10 = 3").select("id"))


@query("split_unchanged", over("SELECT document_id, content_hash IN (SELECT content_hash FROM docs WHERE document_id < 300) AS unchanged FROM docs WHERE document_id >= 300"))
def _(spark, d):
    x = docs(spark, d).select("document_id", "content_hash")
    return M.split_unchanged(x.filter("document_id >= 300"), x.filter("document_id < 300"))


@query("source_freshness", "SELECT o_custkey, CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'stale' WHEN count(*) < 5 THEN 'sparse' ELSE 'current' END AS reason FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    return o.select("o_custkey", F.when(F.col("last") < "1998-01-01", "stale").when(F.col("n") < 5, "sparse").otherwise("current").alias("reason"))


@query("micro_batches", over("SELECT document_id, CAST(floor((sum(num_chunks) OVER (ORDER BY document_id) - num_chunks) / 16) AS BIGINT) AS batch FROM docs WHERE collection_id = 'src4'"))
def _(spark, d):
    return M.document_batches(docs(spark, d).filter("collection_id = 'src4'"), "collection_id", "document_id", "num_chunks", 16).select("document_id", "batch")


@query("supersede_chain", over("SELECT document_id, document_id = superseded_by OR superseded_by NOT IN (SELECT document_id FROM docs) AS rejected FROM docs WHERE superseded_by IS NOT NULL"))
def _(spark, d):
    return M.supersede_check(docs(spark, d).select("document_id", "superseded_by"))
