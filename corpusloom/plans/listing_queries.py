"""Queries over filters, listings and paging."""

from pyspark.sql import functions as F

from corpusloom.operators import listing as L
from corpusloom.plans.inputs import chunks, docs, over, sql, table
from corpusloom.plans.registry import query

KEY = "CASE WHEN instr(lower(filename), '.') > 0 THEN '.' || list_last(string_split(lower(filename), '.')) ELSE lower(filename) END"
OPEN = "coalesce(policy_status, 'clear') <> 'quarantined'"


@query("filter_chunks", over("""SELECT chunk_id FROM chunks LEFT JOIN docs USING (document_id) WHERE document_id IN (1,2,3,5,8,13,21,34)
  AND lower(source_format) IN ('csv','md','pdf') AND coalesce(uploaded_at,'') >= '2026-02' AND coalesce(uploaded_at,'') <= '2026-09-30' AND coalesce(source_type,'upload') IN ('en','upload','fr')"""))
def _(spark, d):
    return L.filter_chunks(chunks(spark, d), docs(spark, d), [1, 2, 3, 5, 8, 13, 21, 34], ["CSV", "md", "pdf"], None, "2026-02", "2026-09-30", ["en", "upload", "fr"])


@query("name_filter", over(f"SELECT document_id, filename FROM docs WHERE contains(lower(filename), 'file1') AND {KEY} IN ('.csv', '.md')"))
def _(spark, d):
    return L.name_filter(docs(spark, d), "FILE1", [".csv", ".md"]).select("document_id", "filename")


@query("extension_keys", over(f"SELECT {KEY} AS key, count(*) AS n FROM docs GROUP BY 1"))
def _(spark, d):
    return docs(spark, d).groupBy(L.extension_key(F.col("filename")).alias("key")).agg(F.count("*").alias("n"))


@query("servable_documents", over(f"SELECT document_id FROM docs WHERE {OPEN} AND document_id IN (SELECT item_id FROM benchmark)"))
def _(spark, d):
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"))
    return L.servable_documents(docs(spark, d), ids=ids).select("document_id")


@query("hidden_document_ids", over("SELECT document_id FROM docs WHERE policy_status = 'quarantined' OR local_only = 1"))
def _(spark, d):
    return L.hidden_ids(docs(spark, d), outside=True)


@query("visible_documents", over(f"SELECT document_id, filename FROM docs WHERE {OPEN}"))
def _(spark, d):
    return L.visible(docs(spark, d)).select("document_id", "filename")


@query("documents_under_root", over("SELECT document_id FROM docs WHERE starts_with(filename, 'file12') OR starts_with(filename, 'file\\12')"))
def _(spark, d):
    return docs(spark, d).filter(F.col("filename").startswith("file12") | F.col("filename").startswith("file\\12")).select("document_id")


@query("documents_by_filename", over("SELECT document_id, uploaded_at FROM docs WHERE lower(filename) = 'file6.csv'"))
def _(spark, d):
    return docs(spark, d).filter(F.lower("filename") == "FILE6.csv".lower()).orderBy(F.desc("uploaded_at")).select("document_id", "uploaded_at")


@query("documents_by_source", over("SELECT document_id FROM docs WHERE collection_id = 'src3' AND source_type = 'en'"))
def _(spark, d):
    return docs(spark, d).filter("collection_id = 'src3' and source_type = 'en'").select("document_id")


for _sort, _order in {"newest": "coalesce(uploaded_at,'') DESC", "oldest": "coalesce(uploaded_at,'9')", "name": "lower(filename)", "name_desc": "lower(filename) DESC", "largest": "coalesce(file_size,-1) DESC", "smallest": "coalesce(file_size, 4611686018427387904)"}.items():
    query(f"find_documents_{_sort}", over(f"SELECT document_id, filename FROM docs WHERE {OPEN} ORDER BY {_order}, document_id LIMIT 25 OFFSET 10"))(
        lambda spark, d, s=_sort: L.find_documents(docs(spark, d), 25, 10, sort=s).select("document_id", "filename")
    )


@query("list_documents_page", over("SELECT document_id FROM docs ORDER BY uploaded_at DESC, document_id LIMIT 20 OFFSET 40"))
def _(spark, d):
    return docs(spark, d).orderBy(F.desc("uploaded_at"), "document_id").offset(40).limit(20).select("document_id")


@query("recent_across_collections", over("SELECT document_id, collection_id FROM docs WHERE collection_id IN ('src1','src2') ORDER BY uploaded_at DESC, document_id LIMIT 15"))
def _(spark, d):
    x = docs(spark, d)
    both = x.filter("collection_id = 'src1'").unionByName(x.filter("collection_id = 'src2'"))
    return both.orderBy(F.desc("uploaded_at"), "document_id").limit(15).select("document_id", "collection_id")


@query("events_keyset_page", "SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND event_id < 700 ORDER BY event_id DESC LIMIT 30")
def _(spark, d):
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    return L.before(e.join(F.broadcast(kind), "event_type", "left_semi"), "event_id", 700, 30).select("event_id", "user_id")


@query("events_since", "SELECT event_id, ts FROM (SELECT * FROM events WHERE event_id > 500 ORDER BY event_id DESC LIMIT 40)")
def _(spark, d):
    return L.since(table(spark, d, "events"), "event_id", 500, 40).select("event_id", "ts")


@query("find_literal", over("""SELECT chunk_id, instr(lower(text), 'stupid') AS at FROM chunks WHERE instr(lower(text), 'stupid') > 0 ORDER BY document_id, chunk_index LIMIT 100"""))
def _(spark, d):
    return L.find_text(chunks(spark, d), "STUPID").select("chunk_id", F.col("at").cast("long").alias("at"))


@query("find_regex", over("SELECT chunk_id FROM chunks WHERE regexp_matches(text, '(?i)token = \"[0-9a-f]+\"') ORDER BY document_id, chunk_index LIMIT 100"))
def _(spark, d):
    return L.find_text(chunks(spark, d), 'token = "[0-9a-f]+"', literal=False).select("chunk_id")


@query("literal_excerpt", over("""SELECT chunk_id, substr(text, greatest(1, p - 80), p - greatest(1, p - 80)) || '«' || substr(text, p, 6) || '»' || substr(text, p + 6, 80) AS excerpt
  FROM (SELECT *, instr(lower(text), 'stupid') AS p FROM chunks) WHERE p > 0"""))
def _(spark, d):
    hit = chunks(spark, d).withColumn("at", F.instr(F.lower("text"), "stupid")).filter("at > 0")
    return hit.select("chunk_id", L.excerpt(F.col("text"), F.col("at"), 6).alias("excerpt"))


@query("first_chunk_matching", over("SELECT document_id, arg_min(chunk_id, (page_number, chunk_index)) AS chunk_id FROM chunks WHERE regexp_matches(text, '\\bof the\\b') GROUP BY 1"))
def _(spark, d):
    return L.first_matching(chunks(spark, d), "\\bof the\\b")


@query("row_keyword_search", """SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'steel') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), 'steel'))
  OR (contains(lower(p_name), 'brand') OR contains(lower(p_type), 'brand') OR contains(lower(p_brand), 'brand')) ORDER BY p_partkey LIMIT 50""")
def _(spark, d):
    p = table(spark, d, "part")
    cols = ["p_name", "p_type", "p_brand"]
    a, b = L.row_search(p, cols, ["steels"], ["p_partkey"], 10**6), L.row_search(p, cols, ["Brand"], ["p_partkey"], 10**6)
    return a.unionByName(b).distinct().orderBy("p_partkey").limit(50).select("p_partkey", "p_name")


@query("effective_sensitivity", over("SELECT document_id, coalesce(sensitivity, CASE WHEN collection_id = 'src1' THEN 'restricted' END, 'internal') AS label FROM docs"))
def _(spark, d):
    return docs(spark, d).select("document_id", L.effective_sensitivity(F.col("sensitivity"), F.when(F.col("collection_id") == "src1", "restricted")).alias("label"))


@query("effective_classification", over("""SELECT document_id, CASE WHEN document_id % 4 = 0 AND NOT (local_only = 1) THEN 'collection' ELSE coalesce(sensitivity, 'collection') END AS label FROM docs"""))
def _(spark, d):
    return docs(spark, d).select("document_id", L.effective_classification(F.col("sensitivity"), F.col("local_only") == 1, F.lit("collection"), F.col("document_id") % 4 == 0).alias("label"))


@query("safe_cells", "SELECT event_id, CASE WHEN regexp_matches(v, '^[=+\\-@\t\r]') THEN '''' || v ELSE v END AS cell FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=1+2' WHEN 1 THEN '-5' WHEN 2 THEN event_type ELSE '@x' END AS v FROM events)")
def _(spark, d):
    v = sql(spark, d, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=1+2' WHEN 1 THEN '-5' WHEN 2 THEN event_type ELSE '@x' END AS v FROM events")
    return v.select("event_id", L.safe_cell(F.col("v")).alias("cell"))


@query("documents_by_policy_status", over("SELECT document_id, policy_status FROM docs WHERE policy_status IN ('flagged', 'quarantined')"))
def _(spark, d):
    return docs(spark, d).filter(F.col("policy_status").isin("flagged", "quarantined")).select("document_id", "policy_status")
