"""Queries over normalisation, deduplication, typed tables and identifiers."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedupe as D
from corpusloom.operators import inference as I
from corpusloom.plans.inputs import docs, over, sql, table
from corpusloom.plans.registry import query

NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '([0-9]),([0-9])', '\\1\\2', 'g'), '[^\\p{L}\\p{N}\\s.]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
SH = f"(SELECT doc_id, w, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN generate_series(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM (SELECT doc_id, [t FOR t IN string_split({NORM}, ' ') IF t <> ''] AS w FROM documents))"


@query("normalize_text", f"SELECT doc_id, {NORM} AS norm, sha1({NORM}) AS hash FROM documents")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))
    return x.select("doc_id", "norm", T.text_hash(F.col("norm")).alias("hash"))


@query("shingle_counts", f"SELECT doc_id, len(s) AS n FROM {SH}")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(T.normalize_text(F.col("text")))).cast("long").alias("n"))


@query("adjacent_jaccard", f"SELECT a.doc_id, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 9) AS jaccard FROM {SH} a JOIN {SH} b ON b.doc_id = a.doc_id + 1")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("s"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return x.join(y, "doc_id").select("doc_id", F.round(D.shingle_jaccard("s", "t"), 9).alias("jaccard"))


@query("exact_duplicates", over("SELECT content_hash, min(document_id) AS first, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1"))
def _(spark, d):
    return D.exact_groups(docs(spark, d), "content_hash", "document_id")


# Written out here, so that the SQL does not take the list from the library that it checks.
MEANING = """('no', 'not', 'never', 'none', 'neither', 'nor', 'without', 'cannot', 'may', 'must', 'shall', 'should', 'can', 'will', 'required', 'optional',
  'prohibited', 'forbidden', 'permitted', 'allowed', 'unless', 'except', 'before', 'after', 'only', 'all', 'any')"""


@query("near_duplicates", f"""WITH f AS (SELECT {NORM} AS norm, min(doc_id) AS id FROM documents GROUP BY 1), w AS (SELECT id, length(norm) AS len, [t FOR t IN string_split(norm, ' ') IF t <> ''] AS w,
  array_to_string(regexp_extract_all(norm, '[0-9]+(?:\\.[0-9]+)?'), ',') || '|' || array_to_string(list_sort(list_distinct([t FOR t IN string_split(norm, ' ') IF t IN {MEANING}])), ',') AS sig FROM f),
  s AS (SELECT id, len, sig, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN generate_series(1, len(w) - 2)]) ELSE [array_to_string(w, ' ')] END AS s FROM w WHERE len(w) > 0),
  p AS (SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS score FROM s a JOIN s b ON a.id < b.id AND a.sig = b.sig AND least(a.len, b.len) >= 0.8 * greatest(a.len, b.len)) SELECT * FROM p WHERE score >= 0.8""")
def _(spark, d):
    return D.near_duplicate_pairs(table(spark, d, "documents"), 0.8, "doc_id")


NAMES = "SELECT doc_id AS document_id, 'report' || (doc_id % 40) || '_final' || CASE doc_id % 4 WHEN 0 THEN '_v1.2' WHEN 1 THEN '_v1.10' WHEN 2 THEN ' (1)' ELSE '' END || '.pdf' AS filename FROM documents"


@query("suggest_supersessions", f"""WITH p AS (SELECT document_id, 'report' || (document_id % 40) || '_final' AS stem, document_id % 4 = 2 AS is_copy, CASE document_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS v FROM ({NAMES})),
  t AS (SELECT document_id, first_value(document_id) OVER (PARTITION BY stem ORDER BY is_copy, v DESC, document_id DESC) AS replaced_by FROM p) SELECT * FROM t WHERE document_id <> replaced_by""")
def _(spark, d):
    return D.suggest_supersessions(sql(spark, d, NAMES))


@query("parse_filename_version", f"SELECT document_id, 'report' || (document_id % 40) || '_final' AS stem, CASE document_id % 4 WHEN 0 THEN '1.2' WHEN 1 THEN '1.10' ELSE '' END AS version, document_id % 4 = 2 AS is_copy FROM ({NAMES})")
def _(spark, d):
    x = D.name_version(F.col("filename"))
    return sql(spark, d, NAMES).select("document_id", x["stem"].alias("stem"), F.array_join(F.transform(x["version"], lambda v: v.cast("string")), ".").alias("version"), x["is_copy"].alias("is_copy"))


@query("fold_results")
def _(spark, d):
    hits = sql(spark, d, "SELECT doc_id div 50 AS query_id, doc_id AS id, doc_id AS rank, 1.0D AS score, doc_id % 10 = 3 AS superseded, text FROM documents")
    return D.fold_results(hits)


@query("without_overlap")
def _(spark, d):
    from corpusloom.plans.inputs import chunks

    return D.without_overlap(chunks(spark, d)).select("chunk_id", F.length("text").alias("n"))


MESS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1,234.5' WHEN 1 THEN '(42)' WHEN 2 THEN '1.5K' WHEN 3 THEN 'n/a' WHEN 4 THEN '-7' ELSE ' 2.5 M ' END AS num,
  CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS flag,
  CASE event_id % 4 WHEN 0 THEN '2026-04-11' WHEN 1 THEN '4/12/2026' WHEN 2 THEN 'Apr 13, 2026' ELSE 'tbd' END AS day FROM events"""


@query("parse_numbers", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN -42 WHEN 2 THEN 1500 WHEN 4 THEN -7 WHEN 5 THEN 2500000 END::DOUBLE AS number FROM events")
def _(spark, d):
    return sql(spark, d, MESS).select("event_id", T.parse_number(F.col("num")).alias("number"))


@query("parse_booleans", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS flag FROM events")
def _(spark, d):
    return sql(spark, d, MESS).select("event_id", T.to_bool(F.col("flag")).alias("flag"))


@query("parse_dates", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2026-04-11' WHEN 1 THEN '2026-04-12' WHEN 2 THEN '2026-04-13' END AS day FROM events")
def _(spark, d):
    return sql(spark, d, MESS).select("event_id", T.parse_date(F.col("day")).alias("day"))


@query("stamp_dates", """WITH s AS (SELECT stamp_id, trim(raw) AS v FROM stamps), p AS (SELECT stamp_id, coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y-%m-%dT%H:%M:%S'), try_strptime(v, '%m/%d/%Y %H:%M'), try_strptime(v, '%d.%m.%Y %H:%M:%S'), try_strptime(v, '%d %b %Y %H:%M'),
    CASE WHEN regexp_full_match(v, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|[+-]\\d\\d:?\\d\\d)') THEN try_strptime(left(v, 19), '%Y-%m-%dT%H:%M:%S') - CASE WHEN v LIKE '%Z' THEN INTERVAL 0 MINUTE ELSE (CASE WHEN substr(v, 20, 1) = '-' THEN -1 ELSE 1 END) * (try_cast(substr(v, 21, 2) AS INT) * 60 + try_cast(right(v, 2) AS INT)) * INTERVAL 1 MINUTE END END) AS t,
  CASE WHEN regexp_matches(v, '[0-9]{4}') THEN coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%d %b %Y'), try_strptime(v, '%Y/%m/%d')) END AS d FROM s) SELECT stamp_id, coalesce(strftime(t, '%Y-%m-%dT%H:%M:%S'), strftime(d, '%Y-%m-%d')) AS day FROM p""")
def _(spark, d):
    return table(spark, d, "stamps").select("stamp_id", T.parse_date(F.col("raw")).alias("day"))


@query("null_markers", f"SELECT count(*) FILTER (WHERE event_id % 6 = 3) AS nums, count(*) FILTER (WHERE event_id % 4 = 3) AS days FROM events")
def _(spark, d):
    return sql(spark, d, MESS).agg(F.count_if(T.is_null_marker(F.col("num"))).alias("nums"), F.count_if(T.is_null_marker(F.col("day"))).alias("days"))


@query("infer_types", "SELECT * FROM (VALUES ('amount', 'real'), ('day', 'text'), ('event_id', 'integer'), ('flag', 'boolean'), ('price', 'currency'), ('share', 'percent'), ('when_', 'date')) AS t(name, type)")
def _(spark, d):
    rows = sql(spark, d, """SELECT CAST(event_id AS STRING) AS event_id, CASE event_id % 10 WHEN 0 THEN 'x' ELSE '1.5' END AS amount, CASE event_id % 4 WHEN 3 THEN 'soon' ELSE '2026-01-01' END AS day,
      CASE event_id % 2 WHEN 0 THEN 'yes' ELSE 'no' END AS flag, '$' || event_id AS price, event_id || '%' AS share, '2026-01-0' || (1 + event_id % 9) AS when_ FROM events""")
    types = I.infer(rows, I.Registry([I.currency(), I.percent()]))
    return spark.createDataFrame(sorted(types.items()), "name string, type string")


@query("typed_table", "SELECT event_id, event_id * 1.5::DOUBLE AS amount, CAST(event_id * 1.5 AS VARCHAR) AS amount__raw, event_id % 2 = 0 AS even FROM events")
def _(spark, d):
    rows = sql(spark, d, "SELECT CAST(event_id AS STRING) AS event_id, CAST(CAST(event_id * 1.5 AS DECIMAL(20,1)) AS STRING) AS amount, CASE event_id % 2 WHEN 0 THEN 'y' ELSE 'n' END AS even FROM events")
    return I.coerce(rows, {"event_id": "integer", "amount": "real", "even": "boolean"}).select("event_id", "amount", "amount__raw", (F.col("even") == 1).alias("even"))


IDS = """SELECT doc_id, 'See https://doi.org/10.1234/AB' || doc_id || '. and arXiv 2401.0' || (1000 + doc_id % 9000) || 'v2, http://x.example.com/' || doc_id || ') ISBN 978-0-306-40615-7 and ISBN 0-306-40615-3' AS text FROM documents"""


@query("find_identifiers", "SELECT doc_id, '10.1234/ab' || doc_id AS doi, '2401.0' || (1000 + doc_id % 9000) AS arxiv, 'http://x.example.com/' || doc_id AS url, '9780306406157' AS isbn, 2024 AS year FROM documents")
def _(spark, d):
    t = F.col("text")
    x = sql(spark, d, IDS).select("doc_id", T.find_dois(t)[0].alias("doi"), T.find_arxiv_ids(t)[0].alias("arxiv"), T.find_urls(t)[1].alias("url"), F.array_join(T.find_isbns(t), ",").alias("isbn"))
    return x.withColumn("year", T.arxiv_year(F.col("arxiv")))


@query("normalize_dois", "SELECT doc_id, '10.1/x' || doc_id AS doi FROM documents")
def _(spark, d):
    return sql(spark, d, "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1/X' WHEN 1 THEN 'doi: 10.1/x' ELSE ' 10.1/X' END || doc_id AS v FROM documents").select("doc_id", T.normalize_doi(F.col("v")).alias("doi"))


@query("clean_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.regexp_replace("text", "([a-z])([a-z])", "$1$2")).alias("text"))


@query("age_labels", "SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS label FROM (SELECT event_id, event_id * 37 AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.age_label(F.col("event_id") * 37).alias("label"))


@query("mask_values", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(c_name, 1, 1) || '***@x.org' ELSE substr(c_name, 1, 2) || repeat('*', length(c_name) - 4) || substr(c_name, length(c_name) - 1, 2) END AS masked FROM customer")
def _(spark, d):
    v = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("@x.org"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", T.mask(v).alias("masked"))


@query("normalize_entities", "SELECT n_nationkey, lower(regexp_replace(n_name, 'S$', '')) AS entity FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.normalize_entity(F.concat(F.lit("("), "n_name", F.lit("),"))).alias("entity"))
