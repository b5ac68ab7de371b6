"""Queries over keyword, vector and hybrid search, and retrieval evaluation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import search as S
from corpusloom.plans.inputs import chunks, entities, over, sql, table
from corpusloom.plans.registry import query

STOP = "(" + ",".join(f"'{w}'" for w in S.STOPWORDS) + ")"
TOKENS = f"[t FOR t IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') IF length(t) >= 2 AND t NOT IN {STOP}]"
QUERY = "trash thand der stupid trash"


def bm25_sql(words: str, k: int, extra: str = "") -> str:
    terms = [w for w in words.split() if len(w) >= 2 and w not in S.STOPWORDS]
    q = " UNION ALL ".join(f"SELECT '{w}' AS term" for w in terms)
    return f"""WITH tok AS (SELECT doc_id AS id, {TOKENS} AS toks FROM documents), dl AS (SELECT id, len(toks) AS dl FROM tok WHERE len(toks) > 0),
  st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), q AS ({q}), p AS (SELECT id, unnest(toks) AS term FROM tok),
  tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
  idf AS (SELECT term, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf FROM df, st),
  sc AS (SELECT id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (id), st GROUP BY id)
  SELECT id, score FROM sc {extra} ORDER BY score DESC, id LIMIT {k}"""


@query("tokenize", f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.tokens(F.col("text")).alias("tokens"))


@query("bm25_search", bm25_sql(QUERY, 10))
def _(spark, d):
    return S.bm25(table(spark, d, "documents"), S.query_terms(spark, QUERY), 10, id_col="doc_id")


@query("bm25_allowed", bm25_sql(QUERY, 20, "WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def _(spark, d):
    allowed = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return S.bm25(table(spark, d, "documents"), S.query_terms(spark, QUERY), 20, allowed, "doc_id")


@query("bm25_index_stats", f"WITH t AS (SELECT {TOKENS} AS toks FROM documents) SELECT count(*) AS documents, avg(len(toks)) AS average_length, (SELECT count(DISTINCT x) FROM (SELECT unnest(toks) AS x FROM t)) AS vocabulary FROM t WHERE len(toks) > 0")
def _(spark, d):
    return S.index_stats(table(spark, d, "documents"), "doc_id", "text")


@query("bm25_postings", f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents WHERE doc_id % 100 < 100) GROUP BY ALL")
def _(spark, d):
    return S.postings(table(spark, d, "documents"), "doc_id", "text")


VEC = "[x::DOUBLE FOR x IN embedding]"
Q7 = "(SELECT [x::DOUBLE FOR x IN embedding] FROM embeddings WHERE vec_id = 7)"
COS = f"round(list_cosine_similarity({VEC}, {Q7}), 6)"


def query_vector(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 7").select("embedding").first()[0]


@query("vector_search", f"SELECT vec_id AS id, {COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def _(spark, d):
    return S.vector_search(table(spark, d, "embeddings"), query_vector(spark, d), 10)


@query("vector_search_allowed", f"SELECT vec_id AS id, {COS} AS score FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark) ORDER BY score DESC, id LIMIT 10")
def _(spark, d):
    return S.vector_search(table(spark, d, "embeddings"), query_vector(spark, d), 10, table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")))


def fused_sql(fusion: str) -> str:
    score = "round(0.7 * coalesce(s, 0) + 0.3 * coalesce(w, 0), 6)" if fusion == "weighted" else "round(0.7::DOUBLE * coalesce(61.0::DOUBLE / (60 + rs), 0) + 0.3::DOUBLE * coalesce(61.0::DOUBLE / (60 + rw), 0), 6)"
    return f"""WITH kw0 AS ({bm25_sql(QUERY, 60)}), sem0 AS (SELECT vec_id AS id, {COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 60),
  s AS (SELECT id, score AS s, row_number() OVER (ORDER BY score DESC, id) AS rs FROM sem0), w AS (SELECT id, score / max(score) OVER () AS w, row_number() OVER (ORDER BY score DESC, id) AS rw FROM kw0)
  SELECT id, {score} AS score FROM s FULL JOIN w USING (id) ORDER BY score DESC, id LIMIT 20"""


for _fusion in ("weighted", "rrf"):

    @query(f"hybrid_search_{_fusion}", fused_sql(_fusion))
    def _(spark, d, fusion=_fusion):
        k = 20
        semantic = S.vector_search(table(spark, d, "embeddings"), query_vector(spark, d), 3 * k)
        keyword = S.bm25(table(spark, d, "documents"), S.query_terms(spark, QUERY), 3 * k, id_col="doc_id")
        return S.hybrid(semantic, keyword, k, 0.7, fusion)


WQ = """(SELECT * FROM (VALUES (1, 'what is the limit?'), (2, 'ERR_4021'), (3, 'ERR_4021 in pump P-101 today'), (4, '"exact words" here'), (5, 'pump'), (6, 'pump seal wear'), (7, 'how the pump seal wears over long time'), (8, 'see camelCase thing')) AS v(id, q))"""


@query("plan_retrieval", "SELECT * FROM (VALUES (1, 0.8::DOUBLE), (2, 0.2), (3, 0.45), (4, 0.2), (5, 0.45), (6, 0.7), (7, 0.8), (8, 0.45)) AS v(id, weight)")
def _(spark, d):
    return spark.sql(f"SELECT * FROM {WQ}").select("id", S.plan_weight(F.col("q"), 0.7).cast("double").alias("weight"))


@query("graph_boost", over("""SELECT id, round(score + coalesce(CASE WHEN m >= 2 THEN 0.15::DOUBLE * s / (1 + s) ELSE 0 END, 0), 6) AS score
  FROM (SELECT chunk_id AS id, 1.0::DOUBLE / (1 + chunk_id) AS score FROM chunks) LEFT JOIN (SELECT chunk_id AS id, sum(ln((SELECT count(*) FROM chunks)::DOUBLE / df) / ln((SELECT count(*) FROM chunks)::DOUBLE)) AS s, count(*) AS m
  FROM entities JOIN (SELECT entity, count(*) AS df FROM entities GROUP BY 1) USING (entity) WHERE entity IN ('the','and','der','les','thand','ing') GROUP BY 1) USING (id)"""))
def _(spark, d):
    c, e = chunks(spark, d), entities(spark, d)
    hits = c.select(F.col("chunk_id").alias("id"), (1.0 / (1 + F.col("chunk_id"))).alias("score"))
    return S.graph_boost(hits, e, e.groupBy("entity").agg(F.count("*").alias("df")), ["the", "and", "der", "les", "thand", "ing"], c.count())


@query("chunk_boosted", "SELECT doc_id AS id, round(1.0::DOUBLE / (1 + doc_id) + 0.5 * coalesce(CASE WHEN doc_id % 7 = 0 THEN -0.4 END, 0), 6) AS score FROM documents")
def _(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (1.0 / (1 + F.col("doc_id"))).alias("score"))
    return S.chunk_boost(x, x.filter("id % 7 = 0").select(F.col("id").alias("chunk_id"), F.lit(-0.4).alias("boost")))


@query("sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS p FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.sigmoid((F.col("value") - 50) / 10), 9).alias("p"))


@query("deep_search", """WITH b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY n_chars % 97 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40),
  f AS (SELECT id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, count(*) AS branches FROM b GROUP BY 1), g AS (SELECT f.*, source AS document_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k FROM f JOIN documents ON doc_id = id)
  SELECT id, score, branches, document_id FROM g WHERE k <= 2 ORDER BY score DESC, id LIMIT 15""")
def _(spark, d):
    x = table(spark, d, "documents")
    one = lambda o: x.orderBy(o.desc(), "doc_id").limit(40).select(F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(o.desc(), "doc_id")).alias("rank"))
    return S.deep_search([one(F.col("n_chars")), one(F.col("n_chars") % 97)], x.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id")), 15)


@query("context_window", over("SELECT chunk_id, upto FROM (SELECT chunk_id, CAST(sum(length(text) + 1) OVER (ORDER BY chunk_index) AS BIGINT) AS upto FROM chunks WHERE document_id = 12 AND abs(chunk_index - 5) <= 2) WHERE upto <= 4000"))
def _(spark, d):
    return S.context_window(chunks(spark, d), 125).select("chunk_id", "upto")


@query("site_keyword_score", "WITH w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents), q AS (SELECT unnest(['trash','thand','der']) AS t), df AS (SELECT t, count(*)::DOUBLE AS df FROM q JOIN w ON list_contains(w, t) GROUP BY 1) SELECT id, round(sum(ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score FROM w JOIN df ON list_contains(w, t) GROUP BY id ORDER BY score DESC, id LIMIT 25")
def _(spark, d):
    s = S.keyword_scores(table(spark, d, "documents"), ["trash", "thand", "der", "trash"], "doc_id")
    return s.orderBy(F.desc("score"), "id").limit(25).filter("score > 0")


@query("vector_neighbours", f"WITH v AS (SELECT vec_id, label, {VEC} AS v FROM embeddings), s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.label <> b.label), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s) SELECT * FROM r WHERE rank <= 6")
def _(spark, d):
    return S.neighbours(table(spark, d, "embeddings"), 6)


@query("quantize_vectors", "WITH m AS (SELECT max(list_max([abs(x::DOUBLE) FOR x IN embedding])) AS m FROM embeddings) SELECT vec_id, [greatest(-127, least(127, round_even(x::DOUBLE * (127.0::DOUBLE / m), 0)))::INT FOR x IN embedding] AS code FROM embeddings, m")
def _(spark, d):
    return S.quantize(table(spark, d, "embeddings")).select("vec_id", "code")


@query("cached_question", "SELECT vec_id AS id, score FROM (SELECT vec_id, " + COS + " AS score FROM embeddings WHERE label = 3) WHERE score >= 0.1 ORDER BY score DESC, id DESC LIMIT 1")
def _(spark, d):
    e = table(spark, d, "embeddings").filter("label = 3")
    score = F.round(S.dot(S.unit(F.col("embedding")), S.unit(S.literal_vector(query_vector(spark, d)))), 6)
    return e.select(F.col("vec_id").alias("id"), score.alias("score")).filter("score >= 0.1").orderBy(F.desc("score"), F.desc("id")).limit(1)


@query("cache_lru_trim", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100")
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("k", k).filter("k <= 100").select("event_id", "event_type")


@query("titled_passages", over("SELECT chunk_id, concat_ws(chr(10), filename, c.text) AS passage FROM chunks c LEFT JOIN docs USING (document_id)"))
def _(spark, d):
    from corpusloom.plans.inputs import docs

    return chunks(spark, d).join(docs(spark, d).select("document_id", "filename"), "document_id", "left").select("chunk_id", F.concat_ws("\n", "filename", "text").alias("passage"))


RES = """(SELECT o_custkey AS query_id, o_orderkey AS unit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority AS category,
  o_orderstatus = 'F' AS relevant, o_orderstatus = 'P' AS stale FROM orders)"""


@query("retrieval_metrics", f"""WITH q AS (SELECT query_id, min(category) AS category, min(rank) FILTER (WHERE relevant) AS best, min(rank) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE relevant) AS units,
  count(*) FILTER (WHERE relevant AND rank <= 5) AS h5, count(*) FILTER (WHERE relevant AND rank <= 10) AS h10 FROM {RES} GROUP BY 1)
  SELECT category, count(*) AS queries, round(avg(h5 / units), 6) AS recall_5, round(avg(h10 / units), 6) AS recall_10, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr,
  round(avg(CASE WHEN best IS NOT NULL AND (stale IS NULL OR stale > best) THEN 1.0 ELSE 0 END), 6) AS revision_safe FROM q WHERE units > 0 GROUP BY 1""")
def _(spark, d):
    return E.summary(E.outcomes(sql(spark, d, f"SELECT * FROM {RES}")), "category")


@query("hits_and_ranks", f"SELECT query_id, coalesce(min(rank) FILTER (WHERE relevant) <= 5, false) AS hit_5, round(coalesce(1.0 / min(rank) FILTER (WHERE relevant), 0), 9) AS reciprocal FROM {RES} GROUP BY 1")
def _(spark, d):
    best = sql(spark, d, f"SELECT * FROM {RES}").groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"))
    return best.select("query_id", E.hit_at(F.col("best"), 5).alias("hit_5"), F.round(E.reciprocal(F.col("best")), 9).alias("reciprocal"))


@query("probe_keywords", f"""WITH t AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT id, term, round(tf * ln(1 + n / df), 6) AS score FROM tf JOIN df USING (term) CROSS JOIN n) SELECT id, term, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(term) DESC, term) AS k FROM s) WHERE k <= 5""")
def _(spark, d):
    x = table(spark, d, "documents")
    return E.probe_keywords(x, x.count(), 5)


@query("citation_summary", "SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) / count(*), 6) AS citation_precision, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END), 6) AS supported_rate, count(*) AS sentences FROM lineitem")
def _(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("cited"), (F.col("l_linestatus") == "F").alias("supported"))
    return x.agg(F.round(E.rate("cited"), 6).alias("citation_precision"), F.round(E.rate("supported"), 6).alias("supported_rate"), F.count("*").alias("sentences"))


@query("report_staleness", over("SELECT collection_id, max(document_id) <> 1000 AS stale FROM docs GROUP BY 1"))
def _(spark, d):
    from corpusloom.plans.inputs import docs

    return docs(spark, d).groupBy("collection_id").agg((F.max("document_id") != 1000).alias("stale"))
