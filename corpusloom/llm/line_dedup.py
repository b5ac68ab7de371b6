"""Operator 1, line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line's set is its distinct lower-case words. Words are ordered by rarity (the count of their hash bucket over the whole
corpus, then their hash). Two lines with Jaccard 0.8 or more have a word of their rarest n - ceil(0.8 n) + 1 in common
(prefix filter), of which the smaller line needs only the first n - ceil(8 n / 9) + 1; sizes within 4:5 (length filter,
part of the join's key as bands of sizes), what is left after the common word (positional filter) and the parity
bitmaps of both sets bound their overlap; pairs that survive are verified on the whole sets. A line that is similar to
any earlier one (by document id, then line number) is removed.

Equal sets are folded first. Then each set is compared with the first that shares its smallest or largest prefix hash, which
settles most members of a group of near copies with one comparison each, and unsettled ones with the sets that settled
many (centres), of any prefix hash in common; only what is unsettled then is joined with all earlier ones, so the work
does not grow with the square of a group.

Defined cases: a null or empty text has no lines to lose; lines without a word stay; a row without an id is kept as it
is and takes no part; rows of one id are one document, whose lines of one number stand or fall together; ties go to the
smaller id, then the smaller line number; extra columns are kept, but that line_dedup sets n_lines and n_removed where a table has columns of these names (the stage
leaves them). Words are told apart by 56-bit hashes."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS, Scratch, let, table

BUCKETS = 1 << 14
#: Removed lines that may be broadcast (about 16 bytes each, so 64 MB); beyond it they are joined by a shuffle.
BROADCAST_LINES = 4_000_000
#: A set that has settled so many others is compared with all open ones that share a prefix word with it.
CENTRE = 8
#: Parts (a power of two) in which the postings are joined, one after another, so that only one part's shuffle is on disk.
PARTS = 2
#: Prefix words of centres that may be broadcast (some 60 bytes each, so 12 MB); beyond it they are joined by parts.
CENTRE_WORDS = 200_000
#: What is compared of a set before its words.
ROW = ["doc_id", "line_no", "n", "bits", "more_bits"]
#: Masks of the bitmaps: each of 128 kinds of words has one bit in one of them, as signed longs.
HALVES = {
    name: [(1 << k % 64) - (1 << 64 if k % 64 == 63 else 0) if k // 64 == half else 0 for k in range(128)]
    for half, name in enumerate(("bits", "more_bits"))
}
#: Sizes of a band of the length filter, largest to smallest.
BAND = 25 / 16
BLANK = " \t\n\x0b\x0c\r"


def plain(text):
    """A text column with spaces for its separators but line feeds. contains() looks for one at a small part of the cost of a replace()."""
    others, spaced = BLANK[1:].replace("\n", ""), text
    for c in others:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.when(reduce(lambda a, b: a | b, (text.contains(c) for c in others)), spaced).otherwise(text)


def tokens_of(text):
    """The words of a plain text column of one line, '' where there are two spaces."""
    return F.split(text, " ", -1)


def worded(line):
    return F.btrim(line, F.lit(BLANK)) != ""


def rarity(docs: DataFrame, text_col: str) -> list[int]:
    """For each hash bucket the logarithm (4 log2) of the count of its words over all documents."""
    line = F.replace(F.lower(plain(F.col(text_col))), F.lit("\n"), F.lit(" "))
    word = docs.select(F.explode(tokens_of(line)).alias("w")).filter("w <> ''")
    counts = word.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("k")).agg(F.count("*").alias("c"))
    ranks = [0] * BUCKETS
    for k, c in counts.select("k", F.least(F.lit(120), F.floor(4 * F.log2(F.col("c") + 1))).cast("int")).collect():
        ranks[k] = c
    return ranks


def token_sets(lines: DataFrame) -> DataFrame:
    """Adds `toks`, the sorted hashes of the distinct words of column `line` (plain and in lower case)."""
    hashes = F.transform(tokens_of(F.col("line")), lambda w: F.xxhash64(w))
    # array_except() drops '' and all but one of equal words; it is compiled, which what stands below a lambda is not.
    return lines.withColumn("toks", F.sort_array(F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))))


def by_rarity(toks, ranks: list[int]):
    """The words of a set, the rarest first: 7 bits of rarity, then 56 bits of hash."""
    known = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")
    rank = lambda h: F.coalesce(F.get(known, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))  # noqa: E731 - no nulls, so that longs are sorted as such
    return F.sort_array(F.transform(toks, lambda h: F.shiftleft(rank(h), 56) + F.shiftrightunsigned(h, 8)))


def parity(toks, masks: list[int]):
    """64 bits: the exclusive or of the masks of all words, which a word's last 7 bits choose."""
    known = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
    return F.aggregate(toks, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(F.get(known, t.bitwiseAND(F.lit(127)).cast("int"))))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) of the lines that have a word, plain and in lower case."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(plain(F.col(text_col)), "\n", -1)).alias("line_no", "line"))
    return lines.filter(F.trim("line") != "").withColumn("line", F.lower("line"))


def apart(a: str, b: str):
    """How many words the bitmaps of two sets tell apart; never more than they differ in."""
    differ = lambda c: F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return differ("bits") + differ("more_bits")


def bounded(a: str, b: str):
    """The length and bitmap filters of two sets n and bits: true of every pair with Jaccard 0.8 or more."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (5 * F.least(f"{a}.n", f"{b}.n") >= 4 * F.greatest(f"{a}.n", f"{b}.n")) & (total >= 9 * apart(a, b))


def chosen_lines(docs: DataFrame, ends: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) of the lines at given places, plain and in lower case; a map over documents where the places are few."""
    places, doc = f"places_{uuid.uuid4().hex}", f"doc_{uuid.uuid4().hex}"
    lists = ends.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(places))
    if ends.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    lines = F.split(plain(F.col(text_col)), "\n", -1)
    found = let(lines, lambda x: F.transform(F.col(places), lambda k: F.struct(k.alias("line_no"), F.get(x, k).alias("line"))))
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).join(lists, F.col("doc_id") == F.col(doc))
    return joined.select("doc_id", F.explode(found).alias("l")).filter("l.line is not null").select("doc_id", "l.line_no", F.lower("l.line").alias("line"))


def verified(scratch: Scratch, name: str, pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(mark, a_doc, a_line) of the pairs (b_doc, b_line, a_doc, a_line) that are similar on the whole sets, mark being b's."""
    ends = pairs.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no")).unionByName(pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line_no"))).distinct()
    ends = scratch.put(f"{name}_ends", ends)
    sets = scratch.put(f"{name}_sets", token_sets(chosen_lines(docs, ends, id_col, text_col)).select("doc_id", "line_no", "toks"))
    side = lambda x: sets.select(F.col("doc_id").alias(f"{x}_doc"), F.col("line_no").alias(f"{x}_line"), F.col("toks").alias(f"{x}_toks"))
    both = pairs.join(side("b"), ["b_doc", "b_line"]).join(side("a"), ["a_doc", "a_line"])
    good = 9 * F.size(F.array_intersect("a_toks", "b_toks")) >= 4 * (F.size("a_toks") + F.size("b_toks"))
    found = scratch.put(name, both.filter(good).select(F.xxhash64("b_toks").alias("mark"), "a_doc", "a_line").distinct())
    scratch.drop(f"{name}_ends", f"{name}_sets")
    return found


def later(b: str, a: str):
    return (F.col(f"{b}.doc_id") > F.col(f"{a}.doc_id")) | ((F.col(f"{b}.doc_id") == F.col(f"{a}.doc_id")) & (F.col(f"{b}.line_no") > F.col(f"{a}.line_no")))


def first_of_pivot(sets: DataFrame) -> DataFrame:
    """One comparison a set: pairs with the first set that has the same smallest or largest prefix hash."""
    pivots = F.array_distinct(F.array(F.array_min("prefix"), F.array_max("prefix")))
    marked = sets.select("doc_id", "line_no", "n", "bits", "more_bits", F.explode(pivots).alias("pivot"))
    firsts = marked.groupBy("pivot").agg(F.min(F.struct("doc_id", "line_no", "n", "bits", "more_bits")).alias("f"), F.count("*").alias("m")).filter("m > 1").select("pivot", "f.*")
    met = marked.alias("b").join(firsts.alias("a"), (F.col("b.pivot") == F.col("a.pivot")) & later("b", "a") & bounded("a", "b"))
    return met.select(F.col("b.doc_id").alias("b_doc"), F.col("b.line_no").alias("b_line"), F.col("a.doc_id").alias("a_doc"), F.col("a.line_no").alias("a_line")).distinct()


def centres(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """The sets that have settled CENTRE others or more, once for each of their prefix words."""
    many = settled.groupBy("a_doc", "a_line").agg(F.count("*").alias("m")).filter(F.col("m") >= CENTRE)
    if many.count() <= BROADCAST_LINES:
        many = F.broadcast(many)
    found = many.join(sets, (F.col("a_doc") == F.col("doc_id")) & (F.col("a_line") == F.col("line_no")))
    return found.select(*ROW, F.explode("prefix").alias("word"))


def centre_pairs(sets: DataFrame, marks: DataFrame, words: DataFrame) -> list[DataFrame]:
    """Pairs of a set that is not of `marks` and an earlier centre that shares a prefix word with it.

    Open sets are not shuffled where the centres' words are few; else the pairs are made in parts of the words."""
    if marks.count() <= BROADCAST_LINES:
        marks = F.broadcast(marks)
    b = sets.join(marks, "mark", "left_anti").select(*ROW, F.explode("prefix").alias("word"))
    if words.count() <= CENTRE_WORDS:
        parts = [(b, F.broadcast(words))]
    else:
        mine = [F.col("word").bitwiseAND(F.lit(PARTS - 1)) == part for part in range(PARTS)]
        parts = [(b.filter(m), words.filter(m)) for m in mine]
    met = [b.alias("b").join(a.alias("a"), (F.col("b.word") == F.col("a.word")) & later("b", "a") & bounded("a", "b")) for b, a in parts]
    return [m.select(F.col("b.doc_id").alias("b_doc"), F.col("b.line_no").alias("b_line"), F.col("a.doc_id").alias("a_doc"), F.col("a.line_no").alias("a_line")).distinct() for m in met]


def flagged(sets: DataFrame, marks: DataFrame) -> DataFrame:
    """sets with `settled` true for those of some marks."""
    known = marks.withColumn("known", F.lit(True))
    if marks.count() <= BROADCAST_LINES:
        known = F.broadcast(known)
    return sets.join(known, "mark", "left").withColumn("settled", F.coalesce("known", F.lit(False))).drop("known")


def prefix_pairs(sets: DataFrame, part: int) -> DataFrame:
    """Pairs of an open set and an earlier one that the filters leave: (b_doc, b_line, a_doc, a_line), b the later.

    Of the prefix words, those of one of PARTS parts. A posting's key is a prefix word and a band of sizes; its place is
    packed with its size and whether the set is open. The larger set posts its whole prefix in its own band; the smaller
    the first part of its prefix, in all bands of sizes up to 5/4 of its own. The larger counts as the left side; of
    equal sizes, the later set."""
    size = F.col("n").cast("long")
    band = lambda n: F.floor(F.log(n) / math.log(BAND) + 1e-9).cast("int")  # noqa: E731 - any function that never falls will do
    open_ = F.when(F.col("settled"), 0).otherwise(1).cast("long")
    packed = F.shiftleft(size, 29).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 1)).bitwiseOR(open_)
    key = F.shiftleft(F.col("word").cast("long"), 6).bitwiseOR(F.col("band").cast("long")).alias("key")
    mine = F.col("word").bitwiseAND(F.lit(PARTS - 1)) == part
    row = ["doc_id", "line_no", "bits", "more_bits"]
    large = sets.select(*row, "n", "settled", band(size).alias("band"), F.posexplode("prefix").alias("at", "word")).filter(mine).select(key, *row, packed.alias("packed"))
    first = F.slice("prefix", 1, F.col("n") - F.floor((8 * size + 8) / F.lit(9)).cast("int") + 1)
    bands = F.explode(F.sequence(band(size), band(F.floor(5 * size / F.lit(4)))))
    small = sets.select(*row, "n", "settled", "prefix", bands.alias("band")).select(*row, "n", "settled", "band", F.posexplode(first).alias("at", "word")).filter(mine).select(key, *row, packed.alias("packed"))
    n_of = lambda x: F.shiftright(F.col(f"{x}.packed"), 29)
    at_of = lambda x: F.shiftright(F.col(f"{x}.packed"), 1).bitwiseAND(F.lit((1 << 28) - 1))
    is_open = lambda x: F.col(f"{x}.packed").bitwiseAND(F.lit(1)) == 1
    total = n_of("l") + n_of("s")
    sizes = (n_of("l") > n_of("s")) | ((n_of("l") == n_of("s")) & later("l", "s"))
    close = (5 * n_of("s") >= 4 * n_of("l")) & (total >= 9 * apart("l", "s"))
    beyond = F.least(n_of("l") - at_of("l"), n_of("s") - at_of("s"))
    fits = sizes & close & (9 * beyond >= 4 * total) & F.when(later("l", "s"), is_open("l")).otherwise(is_open("s"))
    met = large.alias("l").join(small.alias("s"), (F.col("l.key") == F.col("s.key")) & fits)
    pick = lambda c, x, y: F.when(later("l", "s"), F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return met.select(pick("doc_id", "l", "s").alias("b_doc"), pick("line_no", "l", "s").alias("b_line"), pick("doc_id", "s", "l").alias("a_doc"), pick("line_no", "s", "l").alias("a_line")).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no) of every line that is similar to an earlier one; line numbers count from 0."""
    scratch = Scratch(docs.sparkSession, "line_dedup")
    ranks = rarity(docs, text_col)
    n, ordered = F.size("toks"), F.size("ordered")
    worded_sets = token_sets(lines_of(docs, id_col, text_col)).select(
        "doc_id", "line_no", n.alias("n"), F.xxhash64("toks").alias("mark"), *(parity("toks", masks).alias(name) for name, masks in HALVES.items()),
        by_rarity(F.col("toks"), ranks).alias("ordered"),
    )
    prefix = F.slice("ordered", 1, ordered - F.floor((4 * ordered + 4) / F.lit(5)).cast("int") + 1)
    base = scratch.put("base", worded_sets.select(*ROW, "mark", F.transform(prefix, lambda t: t.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix")))
    sets = scratch.put("sets", base.groupBy("mark").agg(F.min(F.struct("doc_id", "line_no", "n", "bits", "more_bits", "prefix")).alias("r"), F.count("*").alias("copies")).select("mark", "copies", "r.*"))
    pairs = scratch.put("pivots", first_of_pivot(sets))
    settled = verified(scratch, "settled", pairs, docs, id_col, text_col)
    marks = scratch.put("settled_marks", settled.select("mark").distinct())
    scratch.drop("pivots")
    words, parts = scratch.put("centres", centres(sets, settled)), []
    for part, pairs in enumerate(centre_pairs(sets, marks, words)):
        parts.append(scratch.put(f"centre_pairs_{part}", pairs))
        del pairs  # with its shuffle
        scratch.drop()
    by_centre = verified(scratch, "by_centre", reduce(DataFrame.unionByName, parts).distinct(), docs, id_col, text_col)
    marks = scratch.put("all_marks", marks.unionByName(by_centre.select("mark")).distinct())
    scratch.drop("centres", "settled_marks", *(f"centre_pairs_{part}" for part in range(len(parts))))
    parts = []
    for part in range(PARTS):
        parts.append(scratch.put(f"pairs_{part}", prefix_pairs(flagged(sets, marks), part)))
        scratch.drop()
    more = verified(scratch, "more", reduce(DataFrame.unionByName, parts).distinct(), docs, id_col, text_col)
    scratch.drop(*(f"pairs_{part}" for part in range(PARTS)))
    gone = scratch.put("gone", marks.unionByName(more.select("mark")).distinct())
    # Most sets are those of one line that stays, so few have to meet the lines again.
    fate = flagged(sets.select("mark", "copies", F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line")), gone)
    fate = scratch.put("fate", fate.filter(F.col("settled") | (F.col("copies") > 1)).drop("copies"))
    if fate.count() <= BROADCAST_IDS:
        fate = F.broadcast(fate)
    here = (F.col("doc_id") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    found = scratch.put("removed", base.select("doc_id", "line_no", "mark").join(fate, "mark").filter(F.col("settled") | ~here).select("doc_id", "line_no").distinct())
    scratch.drop("base", "sets", "settled", "by_centre", "all_marks", "more", "gone", "fate")
    return found


def without_lines(docs: DataFrame, id_col: str, text_col: str, n_lines: str, n_removed: str) -> DataFrame:
    """The documents, their text without the removed lines, with two counts under names of the caller's choice."""
    gone, doc = f"gone_{uuid.uuid4().hex}", f"doc_{uuid.uuid4().hex}"
    removed = removed_lines(docs, id_col, text_col)
    lists = removed.groupBy(F.col("doc_id").alias(doc)).agg(F.array_sort(F.collect_list("line_no")).alias(gone))
    if 2 * removed.count() <= BROADCAST_LINES:  # ids and line numbers
        lists = F.broadcast(lists)
    lines = F.split(text_col, "\n", -1)
    n = F.coalesce(F.size(lines), F.lit(0))
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone))
    joined = docs.join(lists, F.col(id_col).cast("long") == F.col(doc), "left")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(let(lines, lambda x: F.array_join(F.transform(left(x), lambda k: F.get(x, k)), "\n")))
    counts = {n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long"), n_removed: F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return joined.withColumns({**counts, text_col: text}).drop(gone, doc)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, their text without the removed lines, with n_lines and n_removed."""
    return without_lines(docs, id_col, text_col, "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others have before them; one that loses lines and is left without a word goes.

    n_chars, where there is such a column, is that of the text which is left; all other columns are left alone."""
    lines, removed = f"lines_{uuid.uuid4().hex}", f"removed_{uuid.uuid4().hex}"
    kept = without_lines(docs, "doc_id", "text", lines, removed)
    kept = kept.filter((F.col(removed) == 0) | worded(F.coalesce("text", F.lit(""))))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*docs.columns)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (
    SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
t AS (
  SELECT doc_id, line_no, list_sort(list_distinct([w FOR w IN string_split_regex(lower(line), '[\x20\x09-\x0D]+') IF w <> ''])) AS s FROM l),
u AS (SELECT s, min((doc_id, line_no)) AS first, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s),
g AS (
  SELECT DISTINCT b.first FROM u a JOIN u b
  ON a.first < b.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n)),
r AS (
  SELECT t.doc_id, t.line_no, t.s IS NOT NULL AND len(t.s) > 0 AND ((t.doc_id, t.line_no) <> u.first OR g.first IS NOT NULL) AS gone
  FROM t LEFT JOIN u USING (s) LEFT JOIN g ON g.first = u.first)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT coalesce(gone, false)), '') AS text
FROM l JOIN r USING (doc_id, line_no) GROUP BY l.doc_id
"""
