"""Keyword, vector and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import cut

# The 61 words that are not indexed, and BM25's constants.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "were", "will", "with", "this", "but", "they",
    "have", "had", "what", "when", "where", "who", "which", "why", "how",
    "all", "each", "every", "both", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "can", "just", "should", "now",
)
K1, B = 1.2, 0.75
RRF = 60


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, of two characters or more, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(list(STOPWORDS)))


def query_terms(spark, text: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(text)).alias("t")).first().t


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): counted before the shuffle."""
    return chunks.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


#: Texts whose words are counted at a time.
COUNTED = 512


def id_sizes(texts: DataFrame) -> tuple[bool, int]:
    """Whether an id of texts(id, text) stands on several rows, and the characters of all texts."""
    s = texts.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).agg(F.max("n").alias("n"), F.sum("chars").alias("chars")).first()
    return (s.n or 0) > 1, s.chars or 0


def term_counts(texts: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of the words of each row of texts(id, text), counted within the row: nothing is shuffled."""

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED):
                own = batch.slice(at, COUNTED)
                words = own.column(1).flatten().dictionary_encode()
                if not len(words):
                    continue
                width = len(words.dictionary)
                key = pc.list_parent_indices(own.column(1)).to_numpy().astype(np.int64) * width + words.indices.to_numpy()
                pairs, tf = np.unique(key, return_counts=True)
                row = pairs // width
                dl = pc.fill_null(pc.list_value_length(own.column(1)), 0).to_numpy().astype(np.int64)[row]
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(row)), words.dictionary.take(pa.array(pairs % width)), pa.array(tf.astype(np.int64)), pa.array(dl)], names=["id", "term", "tf", "dl"])

    return texts.select("id", tokens(F.col("text")).alias("words")).mapInArrow(count, f"id {dict(texts.dtypes)['id']}, term string, tf long, dl long")


def lengths(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl) of every chunk with a token: others are not in the index."""
    return chunks.select(F.col(id_col).alias("id"), F.size(tokens(F.col(text_col))).cast("long").alias("dl")).filter("dl > 0")


def index_stats(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    n = lengths(chunks, id_col, text_col).agg(F.count("*").alias("documents"), F.avg("dl").alias("average_length"))
    v = chunks.select(F.explode(tokens(F.col(text_col))).alias("t")).agg(F.countDistinct("t").alias("vocabulary"))
    return n.join(F.broadcast(v))  # one row beside one row


def equal_to(word: str):
    return lambda t: t == word


def bm25(chunks: DataFrame, terms: Sequence[str], k: int = 10, allowed: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the k best chunks under BM25, any term being enough; a repeated query term counts again.

    One pass tokenises each chunk into its length and the few counts that the query asks for, which are written to the
    shared folder for statistics and ranking; statistics cover all chunks, whatever the allow-list. The only shuffles are of one row a task (statistics) and k rows a task (ranking)."""
    if not terms:
        return chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    distinct = sorted(set(terms))
    toks = tokens(F.col(text_col))
    base = chunks.select(F.col(id_col).alias("id"), toks.alias("toks")).select(
        "id", F.size("toks").cast("long").alias("dl"), *[F.size(F.filter("toks", equal_to(w))).alias(f"tf{j}") for j, w in enumerate(distinct)]
    )
    base = cut(base.filter("dl > 0"))  # texts are read once; what is written is a few numbers a chunk
    s = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{j}") > 0).alias(f"df{j}") for j in range(len(distinct))]).first()
    import math

    score = F.lit(0.0)
    for j, w in enumerate(distinct):
        df = s[f"df{j}"]
        idf = max(math.log((s.n - df + 0.5) / (df + 0.5)), 0.0) if df else 0.0
        idf = idf if idf > 0 else 1e-6
        tf = F.col(f"tf{j}").cast("double")
        part = F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * F.col("dl") / F.lit(float(s.avg or 1))))
        score = score + F.lit(float(list(terms).count(w))) * part
    hit = base.filter(F.greatest(*[F.col(f"tf{j}") for j in range(len(distinct))], F.lit(0)) > 0) if len(distinct) > 1 else base.filter("tf0 > 0")
    out = hit.select("id", F.round(score, 6).alias("score"))
    if allowed is not None:
        out = out.join(allowed.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    return out.orderBy(F.desc("score"), "id").limit(k)


def unit(v: Column) -> Column:
    """A vector as doubles of length 1; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal_vector(v: Sequence[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in v) + "]"), "array<double>")


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 10, allowed: DataFrame | None = None, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest by cosine, exact; an empty allow-list gives no row."""
    rows = vectors if allowed is None else vectors.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    score = F.round(dot(unit(F.col(column)), unit(literal_vector(query))), 6)
    return rows.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse(semantic: DataFrame, keyword: DataFrame, weight: float = 0.7, fusion: str = "weighted") -> DataFrame:
    """Weighted sum (keyword scores over the best candidate's) or reciprocal ranks scaled to 1 for a first place.

    Both sides are candidate lists of a few k rows."""
    one = Window.partitionBy(F.lit(0))
    s = semantic.select("id", F.col("score").alias("s"), F.row_number().over(one.orderBy(F.desc("score"), "id")).alias("rs"))
    w = keyword.select("id", (F.col("score") / F.max("score").over(one)).alias("w"), F.row_number().over(one.orderBy(F.desc("score"), "id")).alias("rw"))
    both = s.join(w, "id", "full")
    if fusion == "rrf":
        part = lambda r: F.coalesce((RRF + 1.0) / (RRF + F.col(r)), F.lit(0.0))
        score = weight * part("rs") + (1 - weight) * part("rw")
    else:
        score = weight * F.coalesce("s", F.lit(0.0)) + (1 - weight) * F.coalesce("w", F.lit(0.0))
    return both.select("id", F.round(score, 6).alias("score"))


def hybrid(semantic: DataFrame, keyword: DataFrame, k: int, weight: float = 0.7, fusion: str = "weighted") -> DataFrame:
    return fuse(semantic, keyword, weight, fusion).orderBy(F.desc("score"), "id").limit(k)


def is_identifier(token: Column) -> Column:
    """Digit and letter together, five digits, dotted digits, _ / \\ @, camel case or a dotted name."""
    return (
        (token.rlike("[0-9]") & token.rlike("[A-Za-z]")) | token.rlike("[0-9]{5,}") | token.rlike("[0-9]\\.[0-9]")
        | token.rlike("[_/\\\\@]") | token.rlike("[a-z][A-Z]") | token.rlike("[A-Za-z]\\.[A-Za-z]")
    )


def plan_weight(query: Column, base: float) -> Column:
    """The semantic weight for a query: quoted and identifier-heavy ones lean to keywords, questions and long ones to vectors."""
    toks = F.filter(F.split(F.trim(query), "\\s+"), lambda t: t != "")
    ids = F.size(F.filter(toks, is_identifier))
    n = F.size(toks)
    question = query.rlike("\\?\\s*$") | F.lower(query).rlike("^(what|when|where|who|which|why|how)\\b")
    return (
        F.when(query.rlike('"[^"]+"'), 0.2).when((ids > 0) & (2 * ids >= n), 0.2).when(ids > 0, 0.45)
        .when(question | (n >= 6), F.greatest(F.lit(base), F.lit(0.8))).when(n <= 2, 0.45).otherwise(base)
    )


def corpus_filter(entities: DataFrame, n: int, share: float = 0.3) -> DataFrame:
    """Entities of at least two chunks and of at most a share of all."""
    return entities.groupBy("entity").agg(F.count("*").alias("df")).filter(F.col("df").between(2, max(2, int(n * share))))


def graph_boost(hits: DataFrame, entities: DataFrame, df: DataFrame, wanted: Sequence[str], n: int, weight: float = 0.15, min_shared: int = 2) -> DataFrame:
    """Hits that share at least two query entities gain weight * s / (1 + s), s being the sum of the entities' rarities."""
    rarity = df.select("entity", (F.log(F.lit(float(n)) / F.col("df")) / F.log(F.lit(float(n)))).alias("rarity"))
    shared = entities.filter(F.col("entity").isin(list(wanted))).join(rarity, "entity").groupBy(F.col("chunk_id").alias("id")).agg(F.sum("rarity").alias("s"), F.count("*").alias("m"))
    gain = F.when(F.col("m") >= min_shared, weight * F.col("s") / (1 + F.col("s"))).otherwise(0.0)
    return hits.join(shared, "id", "left").select("id", F.round(F.col("score") + F.coalesce(gain, F.lit(0.0)), 6).alias("score"))


def chunk_boost(hits: DataFrame, boosts: DataFrame, scale: float = 0.5) -> DataFrame:
    b = boosts.select(F.col("chunk_id").alias("id"), "boost")
    return hits.join(b, "id", "left").select("id", F.round(F.col("score") + scale * F.coalesce("boost", F.lit(0.0)), 6).alias("score"))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def deep_search(branches: list[DataFrame], docs: DataFrame, k: int, max_per_document: int = 2) -> DataFrame:
    """Reciprocal-rank fusion of ranked branches (id, rank), at most two passages a document."""
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    fused = rows.groupBy("id").agg(F.sum(1 / (F.lit(float(RRF)) + F.col("rank"))).alias("score"), F.count("*").alias("branches"))
    fused = fused.withColumn("score", F.round("score", 9)).join(docs, "id")
    per = Window.partitionBy("document_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("_k", F.row_number().over(per)).filter(F.col("_k") <= max_per_document).orderBy(F.desc("score"), "id").limit(k).drop("_k")


def context_window(chunks: DataFrame, anchor: int, window: int = 2, max_chars: int = 4000) -> DataFrame:
    """The chunks about one, in order, until their text with a line end each passes the cap."""
    place = chunks.filter(F.col("chunk_id") == anchor).select("document_id", F.col("chunk_index").alias("_at"))
    near = chunks.join(F.broadcast(place), "document_id").filter(F.abs(F.col("chunk_index") - F.col("_at")) <= window)  # one row
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("document_id").orderBy("chunk_index"))
    return near.withColumn("upto", upto).filter(F.col("upto") <= max_chars).drop("_at")


def keyword_scores(rows: DataFrame, words: Sequence[str], id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The static site's score: the sum over distinct query words present of ln(1 + N / df); no term frequency, no length."""
    distinct = sorted(set(words))
    has = rows.select(F.col(id_col).alias("id"), F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("w"))
    flags = has.select("id", *[F.array_contains("w", w).alias(f"h{j}") for j, w in enumerate(distinct)])
    s = flags.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"h{j}")).alias(f"d{j}") for j in range(len(distinct))]).first()
    import math

    score = F.lit(0.0)
    for j in range(len(distinct)):
        d = s[f"d{j}"]
        score = score + F.when(F.col(f"h{j}"), math.log(1 + s.n / d) if d else 0.0).otherwise(0.0)
    return flags.select("id", F.round(score, 6).alias("score"))


#: Vectors of the two sides that are multiplied at a time.
STRIP_X, STRIP_Y = 1024, 8192


def neighbours(vectors: DataFrame, k: int = 6, id_col: str = "vec_id", group: str = "label", column: str = "embedding", block: int = 32768) -> DataFrame:
    """(id, other, score, rank): the k nearest vectors of other groups, for every vector, exact.

    Blocks of vectors meet in a grid: a task multiplies one pair of blocks by strips of bounded size and keeps k candidates
    a vector; the grid is the exact search itself, over a set that its caller states. Products in single precision only
    leave out what is further than their error from the k best so far; scores are in double precision."""
    count = vectors.count()
    n = max(1, -(-count // block), min(4, -(-count // 4096)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group).alias("g"), unit(F.col(column)).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("part"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("other", each).select(F.col("part").alias("a"), F.col("other").alias("b"), "id", "g", "v", F.lit(0).alias("side"))
    right = rows.withColumn("other", each).select(F.col("other").alias("a"), F.col("part").alias("b"), "id", "g", "v", F.lit(1).alias("side"))

    def nearest(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        ids, groups = t["id"].to_numpy(), t["g"].to_numpy()
        m = pa.concat_arrays([c.flatten() for c in t["v"].chunks]).to_numpy(zero_copy_only=False).reshape(len(side), -1)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        low = m.astype(np.float32)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for a in range(0, len(x), STRIP_X):
            own = x[a : a + STRIP_X]
            least = np.full(len(own), -np.inf)
            row, other, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in range(0, len(y), STRIP_Y):
                near = y[b : b + STRIP_Y]
                s = low[own] @ low[near].T
                s[groups[own][:, None] == groups[near][None, :]] = -np.inf
                if len(near) > k and not np.isfinite(least).all():
                    least = np.maximum(least, np.partition(s, len(near) - k, axis=1)[:, len(near) - k])
                r, c = np.nonzero((s >= (least - 2e-5).astype(np.float32)[:, None]) & (s > -np.inf))
                c = near[c]
                row, other = np.concatenate([row, r]), np.concatenate([other, c])
                score = np.concatenate([score, np.round(np.einsum("ij,ij->i", m[own[r]], m[c]), 6)])
                order = np.lexsort((ids[other], -score, row))
                row, other, score = row[order], other[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                last = place == k - 1
                least[row[last]] = score[last]
                row, other, score = row[place < k], other[place < k], score[place < k]
            out = [np.concatenate(p) for p in zip(out, (ids[own[row]], ids[other], score))]
        return pa.table({"id": pa.array(out[0], pa.int64()), "other": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.unionByName(right).groupBy("a", "b").applyInArrow(nearest, "id long, other long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def quantize(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """int8 codes under one scale for the whole corpus: 127 over the largest magnitude."""
    top = vectors.agg(F.max(F.array_max(F.transform(column, lambda x: F.abs(x.cast("double"))))).alias("m")).first().m or 1.0
    scale = F.lit(127.0 / top)
    code = F.transform(column, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") * scale))).cast("int"))
    return vectors.withColumn("code", code).withColumn("scale", scale)


def evidence_key(*parts: Column) -> Column:
    """24 hex digits that identify a passage by its collection, document, page and text."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 24)


def same_question(stored: Column, asked: Column, threshold: float) -> Column:
    """Equal after folding case and space; below a threshold of 1 also if numbers and negations agree."""
    flat = lambda q: F.trim(F.regexp_replace(F.lower(q), "\\s+", " "))
    marks = lambda q: F.array_sort(F.regexp_extract_all(F.lower(q), F.lit("[0-9]+|\\b(?:not|no|never|without)\\b"), F.lit(0)))
    return (flat(stored) == flat(asked)) | (F.lit(threshold < 1.0) & (marks(stored) == marks(asked)))


def usable_answers(entries: DataFrame, sources: DataFrame, current: DataFrame) -> DataFrame:
    """Cached entries all of whose sources still have the fingerprint that the entry was made from.

    entries(entry_id), sources(entry_id, document_id, fingerprint), current(document_id, fingerprint)."""
    now = current.select("document_id", F.col("fingerprint").alias("_now"))
    state = sources.join(now, "document_id", "left").groupBy("entry_id").agg(F.bool_and(F.coalesce(F.col("fingerprint") == F.col("_now"), F.lit(False))).alias("ok"))
    return entries.join(state, "entry_id", "left").filter(F.coalesce("ok", F.lit(True))).drop("ok")
