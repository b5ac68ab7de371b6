"""Operator 9, quality rules: Gopher-like counts of each text, and the frequency of its lines across documents of a host.

Lines are normalised (lower case, single spaces), hashed to 64 bits and counted per host in distinct documents. A line
above the host's limit is boilerplate and is taken away; a document that keeps too little of itself is rejected.

Copies of one document would look like boilerplate to a plain count, so documents whose other lines are the same count as
one body of a line, and a line is boilerplate only if at least half of its documents are different bodies.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; a line
repeated in one document counts once; equal rows are documents of their own; null ids are kept as they are; extra
columns are ignored."""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.llm.common import by_ids, cut, lean, table, words

WINDOW = 8
#: Hashes of lines that may be broadcast (about 16 bytes each, so 64 MB); beyond it they are joined by a shuffle.
BROADCAST_LINES = 4_000_000
SYMBOLS = "#*$%&|<>"
#: Odd multipliers of the rolling window hash.
MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, WINDOW + 1)]

SCHEMA = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " lines array<struct<h: long, w: int, rest: long>>"
)


def repeated_words(tokens: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words found twice or more in the text.

    A 64-bit rolling hash finds windows that may repeat; those are then compared word by word."""
    n = len(tokens) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)
    rolled = h[:n] * MULTIPLIERS[0]
    for k in range(1, size):
        rolled += h[k : k + n] * MULTIPLIERS[k]
    ordered = np.sort(rolled)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(rolled, again)).tolist()
    count = Counter(tuple(tokens[i : i + size]) for i in at)
    marks = np.zeros(len(tokens) + 1, np.int64)
    for i in at:
        if count[tuple(tokens[i : i + size])] > 1:
            marks[i] += 1
            marks[i + size] -= 1
    return int(np.count_nonzero(np.cumsum(marks[:-1])))


def mark(h: int) -> int:
    """64 bits that spread a line's hash, so that sets of lines are told apart by the exclusive or of their marks."""
    m = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), seed=1)
    return m - ((m >> 63) << 64)


def line_hash(parts: list[bytes]) -> int:
    """64 bits of a line's words, in lower case with single spaces."""
    h = xxhash.xxh64_intdigest(b" ".join(parts).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass"))
    return h - ((h >> 63) << 64)


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines) of one text."""
    tokens = words(text)
    if not tokens:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, []
    seen, dup = set(), 0
    lines: dict[int, int] = {}
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        h = line_hash(parts)
        lines[h] = lines.get(h, 0) + len(parts)
    body = 0  # of the set of lines; without a line it is the exclusive or with that line's mark
    for h in lines:
        body ^= mark(h)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(tokens), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(tokens), [{"h": h, "w": w, "rest": body ^ mark(h)} for h, w in lines.items()]


def _measured(batches):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("host", pa.string())]
        + [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("lines", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32()), ("rest", pa.int64())])))]
    )
    for b in batches:
        ids, hosts, texts = b.columns
        for k in range(0, b.num_rows, 500):
            rows = [measure(t) for t in texts[k : k + 500].to_pylist()]
            columns = [ids[k : k + 500], hosts[k : k + 500], *zip(*rows)]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_line_docs: int = 10,
    max_line_share: float = 0.02,
    min_body_share: float = 0.5,
    min_left: float = 0.2,
    with_lines: bool = False,
) -> DataFrame:
    """One row per document: its counts, words_removed (in boilerplate lines), base_failed and kept.

    A line is boilerplate at a host when more than min_line_docs of the host's documents and more than max_line_share
    of them have it, at least min_body_share of these being different bodies. A document is depleted, and so rejected,
    when what is left without such lines has under min_words words or under min_left of all its words.

    The text is read once; what is shuffled is a hash and two counts a line, summed before the shuffle."""
    base = cut(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
        .mapInArrow(lean(_measured), SCHEMA)
        .withColumn("row", F.monotonically_increasing_id())
    )
    lines = base.select("row", "host", F.inline("lines"))
    per_line = (
        lines.groupBy("host", "h", "rest").agg(F.count("*").alias("n"))
        .groupBy("host", "h").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_bodies"))
        .filter((F.col("n_docs") > min_line_docs) & (F.col("n_bodies") >= min_body_share * F.col("n_docs")))
    )
    hosts = base.groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = per_line.join(hosts, "host").filter(F.col("n_docs") > max_line_share * F.col("host_docs")).select("host", "h")
    if with_lines:
        frequent = cut(frequent)
    found = lines.select("row", "host", "h", "w").join(frequent, ["host", "h"])
    removed = found.groupBy("row").agg(F.sum("w").alias("words_removed"), *[F.collect_list("h").alias("removed_lines")] * with_lines)
    gone = F.coalesce(F.col("words_removed"), F.lit(0))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (left < min_words) | (left < min_left * F.col("n_words"))
    return base.drop("lines").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("words_removed"), *["host", "removed_lines"] * with_lines,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@F.udf(StringType())
def without_lines(text: str | None, gone: list[int] | None) -> str | None:
    """The text without the lines whose hash is in `gone`."""
    if not text or not gone:
        return text
    hashes = set(gone)
    return "\n".join(x for x in text.split("\n") if not (p := words(x)) or line_hash(p) not in hashes)


def remove_lines(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents without boilerplate lines, from the rows of quality_rules(with_lines=True); n_chars follows if there is one.

    A line goes if its host has it too often, so rows of one id and host can share their hashes. Rows without any keep
    their text as it is."""
    id_, host_, gone_ = (f"{x}_{uuid.uuid4().hex}" for x in ("id", "host", "gone"))
    each = decided.filter("removed_lines is not null").groupBy(F.col("doc_id").alias(id_), F.col("host").alias(host_))
    gone = cut(each.agg(F.array_distinct(F.flatten(F.collect_list("removed_lines"))).alias(gone_)))
    if gone.agg(F.coalesce(F.sum(F.size(gone_)), F.lit(0))).first()[0] <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (host == F.col(host_)), "left")
    out = joined.withColumn(text_col, F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(without_lines(text_col, gone_)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone_).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast("long")))
    return out.select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go, with or without an id; the others lose their boilerplate lines.

    Decisions go back to rows by a hash of id, host and text, since rows that agree in these are decided alike."""
    key = f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, F.xxhash64(F.struct(F.col("doc_id"), F.col("doc_id").isNull(), F.col("source"), F.col("source").isNull(), F.col("text"))))
    decided = cut(quality_rules(keyed.drop("doc_id").withColumnRenamed(key, "doc_id"), with_lines=True).select("doc_id", "host", "kept", "removed_lines"))
    rejected = decided.filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    return remove_lines(by_ids(keyed, rejected, key, "left_anti"), decided.filter("kept"), id_col=key).select(*docs.columns)
