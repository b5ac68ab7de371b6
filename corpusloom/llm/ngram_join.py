"""Operator 10, n-gram Jaccard join of documents: count vectors in R-trees, bounds from summed minima, exact checks.

A document's set is its distinct 5-word shingles; two documents link when 5 * intersection >= 4 * union. Shingles are
hashed into 256 groups and a document is the point of its group counts, whose summed coordinate minima bound an overlap
from above. An R-tree of such points alone would compare all documents of like length, so keys cut below its top level:
of sets this similar, each holds some of its first fifth of shingles, in one common order, in common with the other. All
candidates are answers of the R-tree of a key's members; pairs that it gives are checked on the whole sets.

The common order puts shingles in rarely filled buckets first, so that passages shared by many documents seldom become
keys. Copies are folded into one before anything is compared, and of keys with the same members one goes on. First the
first member of each key asks its tree. Then, of members that are not all in one component yet, those outside the key's
largest component ask, and answers of their own component are dropped as they come. So a group of n near copies costs n
checks and not n * n; as components are closed over links, no link between different components is lost.

Defined cases: null and empty texts have no set and are their own component; texts of under five words are one shingle;
equal rows are copies; an id with several texts links with what any of them links with, and all its rows have one
component; rows without an id have no component; extra columns are ignored. Shingles are told apart by 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS, Scratch, by_ids, lean, table
from corpusloom.llm.components import connected_components

SIZE, GROUPS, BUCKETS = 5, 256, 1 << 16
#: Members of a key's R-tree at most; larger groups are dealt out in pairs of parts.
PART = 20_000
#: Members that are checked against one set in one run.
STAR = 2_000
MULTIPLIERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, SIZE + 1)]


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, letters A to Z lowered."""
    if not text:
        return np.zeros(0, np.uint64)
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64) if tokens else np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = len(h) - size + 1
    rolled = h[:n] * MULTIPLIERS[0]
    for k in range(1, size):
        rolled += h[k : k + n] * MULTIPLIERS[k % len(MULTIPLIERS)] + np.uint64(k)
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0x9FB21C651E98DF25)
    rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def least_overlap(n: int) -> int:
    """The least intersection that a set of n must have with any set it links with."""
    return (4 * n + 4) // 5


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def keys(h: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """The first shingles in the common order (fill of the bucket, then hash): one more than may be missing."""
    first = len(h) - least_overlap(len(h)) + 1
    return h[np.lexsort((h, fill[bucket(h)]))[:first]]


def point(h: np.ndarray) -> bytes:
    """The counts of the groups, one byte each where that is enough, else four."""
    counts = np.bincount((h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def counts_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == GROUPS else np.uint32).astype(np.int32)


class RTree:
    """Points packed by sort-tile-recursive order, with the coordinate maxima and the size range of each node."""

    FAN = 4

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.sizes, self.points, self.visited = sizes, points, 0
        order = self._tile(np.arange(len(sizes)), 0)
        self.order = order
        self.levels = []
        top, low, high = points[order], sizes[order], sizes[order]
        while len(top) > self.FAN:
            cuts = np.arange(0, len(top), self.FAN)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def _tile(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Sort by size, then by the widest coordinate of each slab, until slabs fill one node."""
        if len(at) <= self.FAN:
            return at
        axis = self.sizes[at] if depth == 0 else self.points[at][:, int(np.argmax(np.ptp(self.points[at], axis=0)))]
        at = at[np.argsort(axis, kind="stable")]
        slab = max(self.FAN, -(-len(at) // self.FAN))
        slab = -(-slab // self.FAN) * self.FAN
        return np.concatenate([self._tile(at[k : k + slab], depth + 1) if slab < len(at) else at[k : k + slab] for k in range(0, len(at), slab)])

    @staticmethod
    def allows(top: np.ndarray, low: np.ndarray, high: np.ndarray, size, q: np.ndarray) -> np.ndarray:
        """Whether nodes (maxima, size range) may hold a set that links with (size, q): the summed minima reach 4/9 of both
        sizes and the sizes are close enough."""
        smallest = np.maximum(low, -(-4 * size // 5))
        return (smallest <= high) & (4 * low <= 5 * size) & (9 * np.minimum(top, q).sum(-1) >= 4 * (size + smallest))

    def search(self, size: int, q: np.ndarray) -> np.ndarray:
        """Members whose bound allows a link."""
        at = None
        for top, low, high in reversed(self.levels):
            if at is None:
                at = np.arange(len(top))
            at = at[at < len(top)]
            self.visited += len(at)
            at = at[self.allows(top[at], low[at], high[at], size, q)]
            at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        at = self.order if at is None else self.order[at[at < len(self.order)]]
        self.visited += len(at)
        s = self.sizes[at]
        return at[self.allows(self.points[at], s, s, size, q)]


def shingled(docs: DataFrame, fill, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, mark, keys, point) of each document."""

    def rows(batches):
        table_ = fill.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                sets = [shingles(t) for t in b.columns[1][k : k + 500].to_pylist()]
                yield pa.record_batch(
                    [
                        b.columns[0][k : k + 500],
                        pa.array([len(h) for h in sets], pa.int64()),
                        pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], pa.binary()),
                        pa.array([keys(h, table_).view(np.int64) if len(h) else [] for h in sets], pa.list_(pa.int64())),
                        pa.array([point(h) for h in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "mark", "keys", "point"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(rows), "doc_id long, n long, mark binary, keys array<long>, point binary")


def bucket_fill(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many shingles of all documents each of the 65,536 buckets has: counted in each task, summed by Spark."""

    def rows(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.columns[0]:
                np.add.at(total, bucket(shingles(t.as_py())), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["k", "c"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(text_col).mapInArrow(lean(rows), "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        out[r.k] = r.c
    return out


def checked(scratch: Scratch, name: str, pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ids of which some text has a whole set similar enough to one of the other's.

    Each set b travels once to the runs of its a, each of at most STAR members, and each run gets the sets a once."""
    ids = pairs.select(F.col("a").alias(id_col)).unionByName(pairs.select(F.col("b").alias(id_col))).distinct()

    def sets(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                yield pa.record_batch([b.columns[0][k : k + 500], pa.array([shingles(t).tobytes() for t in b.columns[1][k : k + 500].to_pylist()], pa.binary())], names=["i", "h"])

    hashes = scratch.put(f"{name}_sets", by_ids(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), ids, id_col, "left_semi").mapInArrow(lean(sets), "i long, h binary"))
    size = pairs.groupBy("a").agg(F.count("*").alias("m")).withColumn("runs", F.ceil(F.col("m") / STAR).cast("int"))
    runs = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), "runs").cast("int").alias("run"), "b")
    members = runs.join(hashes, F.col("b") == F.col("i")).select("a", "run", "b", "h")
    centres = size.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run")).join(hashes, F.col("a") == F.col("i"))
    both = members.unionByName(centres.select("a", "run", F.lit(None).cast("long").alias("b"), "h"))

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 5 * both >= 4 * (len(x) + len(y) - both)

    def similar(batches):
        at, centres = None, []
        for batch in batches:
            found = []
            for a, run, b, h in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(h, np.uint64)
                if at != (a, run):
                    at, centres = (a, run), []
                if b is None:
                    centres.append(h)
                elif any(linked(c, h) for c in centres):
                    found.append((a, b))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    dealt = both.repartition(F.col("a"), F.col("run")).sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
    links = scratch.put(name, dealt.mapInArrow(lean(similar), "a long, b long").distinct())
    scratch.drop(f"{name}_sets")
    return links


def grouped(batches, answers):
    """Runs of rows (key, run, ...) to pairs (a, b) of ids, by way of answers(group), which gives arrays of pairs."""
    at, group = None, []
    a_out, b_out, size = [], [], 0

    def flush():
        return pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in (a_out, b_out)], names=["a", "b"])

    def closed():
        nonlocal a_out, b_out, size
        for a, b in answers(group) if len(group) > 1 else ():
            if len(a):
                a_out.append(a)
                b_out.append(b)
                size += len(a)
            if size > 100_000:
                yield flush()
                a_out, b_out, size = [], [], 0

    for batch in batches:
        for key, run, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, run) != at:
                yield from closed()
                at, group = (key, run), []
            group.append(tuple(rest))
    yield from closed()
    if size:
        yield flush()


def tree_of(group: list[tuple], size: int, raw: int) -> RTree:
    return RTree(np.array([g[size] for g in group]), np.stack([counts_of(g[raw]) for g in group]))


def first_answers(group: list[tuple]):
    """Pairs (first, id) of a key's first member with what the R-tree of the others answers. group: doc_id, n, point, centre."""
    own, rest = [g for g in group if g[3]], [g for g in group if not g[3]]
    if not rest:
        return
    tree, ids = tree_of(rest, 1, 2), np.array([g[0] for g in rest], np.int64)
    for doc, n, raw, _ in own:
        hit = ids[tree.search(n, counts_of(raw))]
        hit = hit[hit != doc]
        yield np.full(len(hit), doc, np.int64), hit


def component_answers(group: list[tuple]):
    """Pairs (smaller id, larger id) of members of different components, as the group's R-tree answers to all members but
    those of its largest component, one member at a time. group: doc_id, part, n, point, component."""
    ids, part, component = (np.array([g[k] for g in group], np.int64) for k in (0, 1, 4))
    tree = tree_of(group, 2, 3)
    names, counts = np.unique(component, return_counts=True)
    largest = names[np.argmax(counts)]
    across = bool((part != part[0]).any())
    for k in np.flatnonzero(component != largest):
        hit = tree.search(int(tree.sizes[k]), tree.points[k])
        # a pair of members that both ask is kept where the smaller id does
        hit = hit[(component[hit] != component[k]) & ((component[hit] == largest) | (ids[hit] > ids[k]))]
        hit = hit[part[hit] != part[k]] if across else hit
        other = ids[hit]
        yield np.minimum(other, ids[k]), np.maximum(other, ids[k])


def first_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of keys' first members with what R-trees answer. rows: key, run, doc_id, n, point, centre."""
    dealt = rows.repartition(F.col("key"), F.col("run")).sortWithinPartitions("key", "run", "doc_id")
    return dealt.select("key", "run", "doc_id", "n", "point", "centre").mapInArrow(lean(lambda batches: grouped(batches, first_answers)), "a long, b long").distinct()


def tree_pairs(rows: DataFrame) -> DataFrame:
    """Pairs within a key, of different components, that R-trees answer. rows: key, run, part, doc_id, n, point,
    component; of a group in two parts, only pairs across them."""
    dealt = rows.repartition(F.col("key"), F.col("run")).sortWithinPartitions("key", "run", "doc_id")
    return dealt.select("key", "run", "doc_id", "part", "n", "point", "component").mapInArrow(lean(lambda batches: grouped(batches, component_answers)), "a long, b long").distinct()


def shared_keys(postings: DataFrame, fill: np.ndarray) -> DataFrame:
    """(key, doc_id, first) of the keys of more than one document, with the first of them.

    A key is at most as frequent as its bucket. Buckets of up to four times the mean hold at most 1/16384 of all
    shingles, so a window over one of their keys is bounded; keys of fuller buckets are counted with partial sums and
    joined, which adaptive execution can split."""
    top = [(k, True) for k in np.flatnonzero(fill > 4 * max(1, int(fill.mean()))).tolist()]
    spark = postings.sparkSession
    full = F.broadcast(spark.createDataFrame(top, "bucket long, full boolean"))  # 65,536 rows at most
    dealt = postings.withColumn("bucket", F.shiftrightunsigned("key", 48)).join(full, "bucket", "left").drop("bucket")
    by_key = Window.partitionBy("key").orderBy("doc_id")
    cold = dealt.filter("full is null").select("key", "doc_id", F.first("doc_id").over(by_key).alias("first"), F.lead("doc_id").over(by_key).alias("next"))
    cold = cold.filter("doc_id <> first or next <> doc_id").select("key", "doc_id", "first")
    hot = dealt.filter("full").select("key", "doc_id")
    firsts = hot.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select("key", "first")
    return cold.unionByName(hot.join(firsts, "key").select("key", "doc_id", "first"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    filled = bucket_fill(docs, text_col)
    base = scratch.put("base", shingled(docs, spark.sparkContext.broadcast(filled), id_col, text_col))
    usable = base.filter("n > 0 and doc_id is not null")
    marks = usable.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select("mark", "first")
    marks = scratch.put("marks", marks)
    if marks.count() <= BROADCAST_IDS // 4:
        marks = F.broadcast(marks)
    copied = scratch.put("copied", usable.select("doc_id", "mark").join(marks, "mark"))
    # Of equal sets the first goes on; of an id with several texts, each that is not a copy.
    gone = scratch.put("gone", copied.filter("doc_id <> first").select("doc_id", "mark").distinct())
    many = gone.count()
    one = usable.join(F.broadcast(gone) if many <= BROADCAST_IDS // 4 else gone, ["doc_id", "mark"], "left_anti")
    every = scratch.put("every", shared_keys(one.select("doc_id", F.explode("keys").alias("key")), filled))
    # Keys with the same members (by their number, first, last and two checksums) have the same tree: the least goes on.
    sums = every.groupBy("key", "first").agg(F.count("*").alias("m"), F.max("doc_id").alias("last"), F.expr("bit_xor(xxhash64(doc_id))").alias("x"), F.expr("bit_xor(xxhash64(doc_id, 7))").alias("y"))
    kept = scratch.put("kept", sums.groupBy("m", "first", "last", "x", "y").agg(F.min("key").alias("key")).select("key", "first", "m"))
    shared = scratch.put("shared", every.join(kept.select("key"), "key", "left_semi"))
    scratch.drop("every")
    sizes = usable.select("doc_id", "n", "point")
    split = kept.withColumn("runs", F.ceil(F.col("m") / PART).cast("int"))
    members = shared.filter("doc_id <> first").join(split.filter("runs > 1").select("key", "runs"), "key", "left")
    members = members.select("key", F.pmod(F.xxhash64("doc_id"), F.coalesce("runs", F.lit(1))).cast("int").alias("run"), "doc_id", F.lit(False).alias("centre"))
    centres = split.select("key", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("first").alias("doc_id"), F.lit(True).alias("centre"))
    asked = scratch.put("asked", first_pairs(members.unionByName(centres).join(sizes, "doc_id")))
    links = checked(scratch, "links", asked, docs, id_col, text_col)
    labels = scratch.put("labels", connected_components(links))
    placed = shared.select("key", "doc_id").join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = scratch.put("placed", placed)
    scratch.drop("shared", "kept")
    # The one pair of a key of two has been checked already.
    live = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).filter("low <> high and m > 2")
    live = live.select("key", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    rows = placed.join(live, "key").join(sizes, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    # A group in several parts is dealt out as every pair of parts; run = low part * parts + high part.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).withColumn("run", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
    near = scratch.put("near", tree_pairs(rows).join(asked, ["a", "b"], "left_anti"))
    scratch.drop("placed", "asked")
    more = checked(scratch, "more", near, docs, id_col, text_col)
    # An id with several texts links what they are linked with.
    several = usable.groupBy("doc_id").agg(F.min("mark").alias("l"), F.max("mark").alias("h")).filter("l <> h").select("doc_id")
    own = copied.join(several, "doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    labels = scratch.put("all_labels", connected_components(links.unionByName(more).unionByName(own)))
    found = scratch.put(
        "found",
        base.select("doc_id", F.col("n").alias("n_shingles"), "mark")
        .join(marks, "mark", "left").withColumn("first", F.coalesce("first", "doc_id")).join(labels, F.col("first") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "first"))).alias("component_id")),
    )
    scratch.drop("base", "marks", "copied", "near", "gone", "labels", "links", "more", "all_labels")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows without an id stay."""
    gone = ngram_join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    kept = by_ids(docs, gone, "doc_id", "left_anti")
    return kept


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
c(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM c WHERE c.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
