"""Queries over segmentation, page readers, sinks, streams and the browser-side operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import segment as G
from corpusloom.plans import sql_surface
from corpusloom.plans.inputs import docs, over, sql, table
from corpusloom.plans.registry import query
from corpusloom.sources import readers
from corpusloom.streaming import streams


@query("chunk_documents")
def _(spark, d):
    return G.chunk(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text"))


@query("sentences")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(G.sentences("text")).alias("k", "sentence"))


@query("extract_entities")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(G.extract_entities("text")).alias("k", "entity"))


@query("acronyms", "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\b[A-Z]{2,6}\\b'))) AS acronyms FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def _(spark, d):
    x = table(spark, d, "documents").filter(~F.col("text").rlike("[^\\x00-\\x7F]"))
    return x.select("doc_id", F.array_sort(G.acronyms(F.col("text"))).alias("acronyms"))


@query("content_words", "SELECT doc_id, len([w FOR w IN regexp_extract_all(lower(text), '[a-z]{3,}') IF w NOT IN ('and','the','was','were','with','for','that','this','from','are','has','its','but','they','have','had','what','when','where','who','which','why','how','all','each','every','both','few','more','most','other','some','such','nor','not','only','own','same','than','too','very','can','just','should','now','will')]) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(G.content_words(F.col("text"))).cast("long").alias("n"))


@query("display_forms", "WITH t AS (SELECT doc_id AS passage, lower(w) AS term, w AS form FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents)), c AS (SELECT term, form, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT term, arg_min(form, (-n, form = lower(form), form)) AS form FROM c GROUP BY 1) SELECT b.term, form, passages FROM b JOIN (SELECT term, count(DISTINCT passage) AS passages FROM t GROUP BY 1) USING (term)")
def _(spark, d):
    w = table(spark, d, "documents").select(F.col("doc_id").alias("passage"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("form"))
    return G.display_form(w.withColumn("term", F.lower("form")))


CUES = "SELECT conv_id AS document_id, '[' || lpad(CAST(turn % 60 AS VARCHAR(2)), 2, '0') || ':' || lpad(CAST((turn * 7) % 60 AS VARCHAR(2)), 2, '0') || '] ' || role AS text FROM conversations"


@query("timed_cues", f"WITH c AS (SELECT document_id, CAST(substr(text, 2, 2) AS INT) * 60 + CAST(substr(text, 5, 2) AS INT) AS start, trim(substr(text, 8)) AS text FROM ({CUES})) SELECT document_id, start, coalesce((SELECT min(x.start) FROM c x WHERE x.document_id = c.document_id AND x.start > c.start), start + 5) AS \"end\", text FROM c")
def _(spark, d):
    return G.timed_cues(sql(spark, d, CUES))


@query("uncovered_lines", "WITH s AS (SELECT l_orderkey AS document_id, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INT) % 14 AS e FROM lineitem), u AS (SELECT * FROM s UNION ALL SELECT o_orderkey, 101, 101 FROM orders), c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY document_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM u) SELECT document_id, covered + 1 AS start, start - 1 AS \"end\" FROM c WHERE start > covered + 1")
def _(spark, d):
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 14).alias("end"))
    return G.gaps(spans, table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(100).alias("lines")))


@query("html_sections")
def _(spark, d):
    import pandas as pd
    from pyspark.sql import types as TY

    @F.pandas_udf(TY.ArrayType(TY.StringType()))
    def sections(html: pd.Series) -> pd.Series:
        return pd.Series([readers.html_sections(h or "") for h in html])

    return table(spark, d, "pages").select("page_id", F.posexplode(sections("html")).alias("k", "section"))


@query("markdown_sections", "SELECT doc_id, CAST(len([x FOR x IN string_split(chr(10) || text, chr(10) || '# ') IF trim(x) <> '']) AS BIGINT) AS n FROM (SELECT doc_id, '# a' || chr(10) || text || chr(10) || '# b' || chr(10) || 'c' AS text FROM documents WHERE NOT regexp_matches(text, '\n#{1,2}\\s'))")
def _(spark, d):
    x = table(spark, d, "documents").filter(~F.col("text").rlike("\n#{1,2}\\s")).select("doc_id", F.concat(F.lit("# a\n"), F.col("text"), F.lit("\n# b\nc")).alias("text"))
    parts = F.filter(F.split("text", "(?m)(?=^#{1,2}\\s+)"), lambda s: F.trim(s) != "")
    return x.select("doc_id", F.size(parts).cast("long").alias("n"))


@query("paginate_lines", "WITH l AS (SELECT doc_id, CAST(floor((i - 1) / 3) AS BIGINT) AS p, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)), g AS (SELECT doc_id, p, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS page_number, text FROM g WHERE trim(text) <> ''")
def _(spark, d):
    from corpusloom.functions.text import let

    pages = let(F.split("text", "\n"), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / F.lit(3)).cast("int")), lambda k: F.array_join(F.slice(w, k * 3 + 1, F.lit(3)), "\n")))
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.filter(pages, lambda p: F.trim(p) != "")).alias("k", "text"))
    return x.select("doc_id", (F.col("k") + 1).cast("long").alias("page_number"), "text")


@query("markdown_export", "SELECT doc_id, '# doc' || doc_id || chr(10) || chr(10) || 'Source: ' || source || chr(10) || chr(10) || text || chr(10) AS page FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("# doc"), F.col("doc_id").cast("string"), F.lit("\n\nSource: "), "source", F.lit("\n\n"), "text", F.lit("\n")).alias("page"))


@query("export_manifest", "SELECT source, count(*) AS passages, CAST(sum(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM documents GROUP BY 1")
def _(spark, d):
    part = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")  # a sum needs no order and no list of a source's passages
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("passages"), F.sum(part).alias("checksum"))


@query("table_export", "SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS even FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no").alias("even"))


@query("browser_row_filter", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'gear') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand')")
def _(spark, d):
    row = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").filter(F.contains(row, F.lit("gear")) & F.contains(row, F.lit("brand"))).select("p_partkey")


@query("browser_sort", over("SELECT document_id, file_size FROM docs ORDER BY file_size ASC NULLS LAST, document_id"))
def _(spark, d):
    return docs(spark, d).orderBy(F.asc_nulls_last("file_size"), "document_id").select("document_id", "file_size")


@query("browser_excerpt", "SELECT doc_id, substr(text, greatest(1, p - 100), 320) AS excerpt FROM (SELECT doc_id, text, CASE WHEN instr(lower(text), 'the') > 0 THEN instr(lower(text), 'the') ELSE 1 END AS p FROM documents)")
def _(spark, d):
    at = F.greatest(F.instr(F.lower("text"), "the"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.substring(F.col("text"), F.greatest(F.lit(1), at - 100), F.lit(320)).alias("excerpt"))


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return streams.tumbling(table(spark, d, "events"))


@query("window_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS start FROM events) GROUP BY 1")
def _(spark, d):
    return streams.sliding(table(spark, d, "events"))


@query("window_session", "WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query("events_deduplicated", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return streams.deduplicated(e.unionByName(e)).select("event_id")


@query("stream_static_join", "SELECT event_id, n_name FROM events JOIN nation ON n_nationkey = user_id % 25")
def _(spark, d):
    e, n = table(spark, d, "events"), table(spark, d, "nation")
    return e.join(n, e.user_id % 25 == n.n_nationkey).select("event_id", "n_name")


@query("token_bucket")
def _(spark, d):
    return streams.token_bucket(table(spark, d, "events"))


@query("query_table", "SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END)::BIGINT AS urgent FROM orders GROUP BY 1")
def _(spark, d):
    statement = "SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS urgent FROM csv_data_orders GROUP BY 1 ORDER BY 1"
    columns, rows, _ = sql_surface.query_table(spark, statement, {"csv_data_orders": table(spark, d, "orders")}, deadline=60)
    return spark.createDataFrame(rows, f"{columns[0]} string, {columns[1]} long, {columns[2]} long")


@query("table_rows", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 2000")
def _(spark, d):
    return table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(2000).select("l_orderkey", "l_linenumber")
