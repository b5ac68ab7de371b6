"""Operator 5, benchmark decontamination: latent semantic retrieval, then longest-common-subsequence and answer checks.

The words of the benchmark are the features. Their document frequencies come from all documents; a randomised SVD of
TF-IDF passages, whose products are summed over partitions, gives a latent space in which every passage of every
document (two lengths of overlapping windows) is compared with every item by cosine. Candidates are checked on words:
the longest common subsequence of the item's content words with the passage and its surroundings, and for looser
matches also the item's answer, its rarest words.

Defined cases: null and empty texts and items match nothing; an item without five content words is compared by all its
words; an empty benchmark gives no row; equal rows match alike; rows without an id are not reported; extra columns are
ignored."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, by_ids, cut, lean, table

TERM = re.compile(r"\w+")
#: Beyond ASCII, characters that end a word; a text without them is cut at ASCII bytes alone, for which there is a table.
BREAK = re.compile(r"[^\w\x00-\x7f]")
CUTS = bytes(b if b > 127 or TERM.match(chr(b)) else 32 for b in range(256))
#: Words of a block; passages are runs of 2 and of 5 blocks that overlap by all but one block.
BLOCK, RUNS = 12, (2, 5)
#: A word of over this share of the documents says nothing about an item.
COMMON = 0.2
#: Items and passages that are compared at a time, so that the matrix of cosines and the counts by block stay small.
ITEMS, PASSAGES = 512, 8192
#: Items that a task holds at a time, with their words, vectors and the lists of items by feature.
QUERIES = 20_000
#: Entries of sparse rows that are multiplied at a time, some 10 MB each for the product and its copies.
ENTRIES = 8_192
#: With up to so many features their products by pairs are summed, 100 MB a task; else the passages are multiplied anew each time.
DENSE = 5_000
#: Numbers of a block of those sums, and tasks that sum.
SUMS, SUMMERS = 1 << 18, 16
#: Words of small documents that are searched together.
TOGETHER = 4096


def words_of(text: str | None) -> list[str]:
    """What TERM finds in a text in lower case."""
    text = text.lower() if text else ""
    if not text.isascii() and BREAK.search(text):
        return TERM.findall(text)
    return text.encode("utf-8", "surrogatepass").translate(CUTS).decode("utf-8", "surrogatepass").split()


class Lexicon:
    """The benchmark's words as features, their weights, and each item's words, content words and answer."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_docs: int):
        known = sorted({w for _, t in items for w in words_of(t)})
        self.weight = {w: float(np.log((n_docs + 1) / (df.get(w, 0) + 1)) + 0.1) for w in known}
        common = {w for w in known if df.get(w, 0) > COMMON * max(10, n_docs)}
        self.feature = {w: k for k, w in enumerate(w for w in known if w not in common)}
        self.idf = np.array([self.weight[w] for w in self.feature], np.float32)
        self.ids, self.content, self.answer, self.words = [], [], [], []
        for i, t in items:
            all_words = words_of(t)
            if not all_words:
                continue
            content = [w for w in all_words if w in self.feature]
            self.ids.append(i)
            self.words.append(len(all_words))
            self.content.append(content if len(content) >= 5 else all_words)
            self.answer.append(sorted(set(self.content[-1]), key=lambda w: (-self.weight[w], w))[:4])

    def features(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.feature.get, tokens, repeat(-1)), np.int64, len(tokens))


def tfidf(rows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of unit rows."""
    at, feature, weight = [], [], []
    for k, f in enumerate(rows):
        if len(f):
            u, c = np.unique(f, return_counts=True)
            w = (1 + np.log(c)) * idf[u]
            at.append(np.full(len(u), k))
            feature.append(u)
            weight.append(w / np.sqrt((w * w).sum()))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(at), np.concatenate(feature), np.concatenate(weight)


def gram(rows: tuple[np.ndarray, np.ndarray, np.ndarray], q: np.ndarray) -> np.ndarray:
    """A^T (A q) for sparse unit rows A, some rows at a time: both products are sums over runs of sorted entries."""
    at, feature, weight = rows
    out = np.zeros_like(q)
    a = 0
    while a < len(at):
        b = len(at) if a + ENTRIES >= len(at) else int(np.searchsorted(at, at[a + ENTRIES]))  # no row is cut in two
        b = b if b > a else int(np.searchsorted(at, at[a], side="right"))
        f, w = feature[a:b], weight[a:b, None]
        first = np.flatnonzero(np.concatenate([[True], at[a + 1 : b] != at[a : b - 1]]))
        y = np.repeat(np.add.reduceat(w * q[f], first, axis=0), np.diff(np.append(first, b - a)), axis=0) * w
        order = np.argsort(f, kind="stable")
        g = f[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out[g[first]] += np.add.reduceat(y[order], first, axis=0)
        a = b
    return out


def passage_words(docs: DataFrame, known: list[str], text_col: str) -> DataFrame:
    """(k, c) of every document: the known words of its long passages as passage * len(known) + number, and how often."""
    shared, step = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(known)}), BLOCK * RUNS[-1]

    def counted(batches):
        number = shared.value
        for b in batches:
            keys, counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for t in b.columns[0]:  # one text at a time is a string
                words = words_of(t.as_py())
                own = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                at = np.flatnonzero(own >= 0)
                k, c = np.unique(at // step * len(number) + own[at], return_counts=True)
                keys.append(k)
                counts.append(c)
                sizes.append(len(k))
            ends = pa.array(np.cumsum(sizes), pa.int32())
            yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys), pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts), pa.int32()))], names=["k", "c"])

    return docs.select(text_col).mapInArrow(lean(counted), "k array<long>, c array<int>")


def document_frequency(passages: DataFrame, known: list[str]) -> tuple[dict[str, int], int]:
    """Documents with each known word, and all: counted by task, summed by Spark."""
    n = len(known)

    def counted(batches):
        total, rows = np.zeros(n, np.int64), 0
        for b in batches:
            rows += b.num_rows
            once = np.unique(pc.list_parent_indices(b.column(0)).to_numpy().astype(np.int64) * n + b.column(0).flatten().to_numpy() % n)
            total += np.bincount(once % n, minlength=n)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *some], pa.int64()), pa.array([rows, *total[some]], pa.int64())], names=["w", "c"])

    df = {r.w: r.c for r in passages.select("k").mapInArrow(lean(counted), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()}
    rows = df.pop(-1, 0)
    return {known[w]: c for w, c in df.items()}, rows


def unit_rows(batch: pa.RecordBatch, feature_of: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `tfidf` makes of the passages of passage_words."""
    n, k = len(feature_of), batch.column(0).flatten().to_numpy()
    document, feature = pc.list_parent_indices(batch.column(0)).to_numpy(), feature_of[k % n]
    some = feature >= 0
    document, passage, feature = document[some], k[some] // n, feature[some]
    if not len(feature):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    new = np.concatenate([[True], (document[1:] != document[:-1]) | (passage[1:] != passage[:-1])])
    at = np.cumsum(new) - 1
    w = (1 + np.log(batch.column(1).flatten().to_numpy()[some])) * idf[feature]
    return at, feature, w / np.sqrt(np.add.reduceat(w * w, np.flatnonzero(new)))[at]


def add_pairs(total: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """total += A^T A for sparse unit rows A, some rows at a time: each row adds the products of its pairs of entries."""
    at, feature, weight = rows
    size = np.bincount(at)
    begin = np.cumsum(size) - size
    a = 0
    while a < len(at):
        b = len(at) if a + ENTRIES >= len(at) else int(begin[at[a + ENTRIES]])  # no row is cut in two
        b = b if b > a else int(begin[at[a]] + size[at[a]])
        n = size[at[a:b]]
        left = np.repeat(np.arange(a, b), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n - begin[at[a:b]], n)
        np.add.at(total.ravel(), feature[left] * len(total) + feature[right], (weight[left] * weight[right]).astype(total.dtype))
        a = b


def fit_space(passages: DataFrame, known: list[str], lexicon: Lexicon, rank: int = 128, extra: int = 16, powers: int = 2, seed: int = 5) -> np.ndarray:
    """Features to latent dimensions: right singular vectors over singular values, from a randomised SVD.

    A is the benchmark's items and all passages of all documents. With few features A^T A is summed once over the passages
    and written by blocks of its rows, which are multiplied by Q where they are; with many, A^T(AQ) is summed over the
    passages each time. The driver orthonormalises matrices of features by rank."""
    n, context = len(lexicon.feature), passages.sparkSession.sparkContext
    shared = context.broadcast((np.array([lexicon.feature.get(w, -1) for w in known]), lexicon.idf))
    own = tfidf([f[f >= 0] for f in map(lexicon.features, lexicon.content)], lexicon.idf)
    height, scratch = max(1, SUMS // n), Scratch(passages.sparkSession, "gram")

    def paired(batches):
        total = np.zeros((n, n), np.float32)
        for b in batches:
            add_pairs(total, unit_rows(b, *shared.value))
        for k in range(0, n, height):
            if total[k : k + height].any():
                yield pa.record_batch([pa.array([k]), pa.array([total[k : k + height].tobytes()], pa.binary())], names=["k", "m"])

    def added(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_buffer(), np.float32).astype(np.float64) for m in parts["m"])
        return pa.table({"k": parts["k"].slice(0, 1), "m": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    rows = passages.coalesce(SUMMERS)
    if n <= DENSE:
        rows = scratch.put("sums", rows.mapInArrow(lean(paired), "k long, m binary").groupBy("k").applyInArrow(added, "k long, m binary"))

    def product(q: np.ndarray) -> np.ndarray:
        sent = context.broadcast(q)

        def summed(batches):
            total = np.zeros_like(sent.value)
            for b in batches:
                total += gram(unit_rows(b, *shared.value), sent.value)
            yield pa.record_batch([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["k", "m"])

        def multiplied(batches):
            for b in batches:
                for k, m in zip(b.columns[0].to_pylist(), b.columns[1]):
                    yield pa.record_batch([pa.array([k]), pa.array([(np.frombuffer(m.as_buffer(), np.float32).reshape(-1, n) @ sent.value).tobytes()], pa.binary())], names=["k", "m"])

        total = gram(own, q)
        for r in rows.mapInArrow(lean(multiplied if n <= DENSE else summed), "k long, m binary").toLocalIterator():
            part = np.frombuffer(bytes(r.m)).reshape(-1, q.shape[1])
            total[r.k : r.k + len(part)] += part
        sent.destroy()
        return total

    width = min(n, rank + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    for _ in range(powers):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    scratch.drop(*list(scratch.paths))
    keep = np.argsort(-values)[: min(rank, width)]
    keep = keep[values[keep] > 1e-9 * max(1e-30, values.max())]
    return ((q @ vectors[:, keep]) / np.sqrt(values[keep])).astype(np.float32)


def common_subsequence(masks: dict[str, int], tokens: list[str], full: int) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: masks has the item's positions of each word."""
    row = full
    for w in tokens:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return (~row & full).bit_count()


def runs_summed(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of the table's rows over short runs that begin at `first`: row after row of all runs at once."""
    size = np.diff(np.append(first, len(rows)))
    total = table[rows[first]]
    for k in range(1, size.max(initial=0)):
        some = np.flatnonzero(size > k)
        total[some] += table[rows[first[some] + k]]
    return total


class Searcher:
    """What a task needs: lexicon, latent space, items in it, and the word checks."""

    def __init__(self, lexicon: Lexicon, space: np.ndarray, cosine: float, near: float, loose: float):
        self.lex, self.cosine, self.near, self.loose = lexicon, cosine, near, loose
        self.space = space * lexicon.idf[:, None]
        q = np.array([self.space[np.unique(f[f >= 0])].sum(0) for f in map(lexicon.features, lexicon.content)]).reshape(len(lexicon.ids), -1)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        self.items = q / np.where(norm > 0, norm, 1)
        self.masks, self.full = [], []
        for content in lexicon.content:
            m: dict[str, int] = {}
            for k, w in enumerate(content):
                m[w] = m.get(w, 0) | 1 << k
            self.masks.append(m)
            self.full.append((1 << len(content)) - 1)
        # Which items have a feature among their words; only counts of items that are nothing but features bound anything.
        self.least = np.zeros(len(lexicon.ids), np.int64)
        features, items, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, f in enumerate(map(lexicon.features, lexicon.content)):
            own, n = np.unique(f[f >= 0], return_counts=True)
            features.append(own)
            items.append(np.full(len(own), k, np.int64))
            counts.append(n)
            if (f >= 0).all():
                self.least[k] = np.ceil(loose * len(f) - 1e-9)
        # The items of each feature one after another, with how often they have it; item_of[starts[f]:starts[f + 1]].
        feature = np.concatenate(features)
        order = np.argsort(feature, kind="stable")
        self.item_of, self.times = np.concatenate(items)[order], np.concatenate(counts)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=len(lexicon.feature)))])
        self.reach = 2 * np.array(lexicon.words, np.int64)  # words around a passage in which an item is looked for
        self.whole = [k for k, (_, f) in enumerate(zip(lexicon.ids, map(lexicon.features, lexicon.content))) if not (f >= 0).any()]

    def items_of(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of the items that have a feature: rows of `features`, entries of item_of and times."""
        n = self.starts[features + 1] - self.starts[features]
        row = np.repeat(np.arange(len(features)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[features], n)

    def close(self, docs: list[list[str]], likely: bool):
        """(document, item, cosine, first and last word) of the passages that are close enough to an item, as arrays.

        The documents' blocks stand one after another and passages end with their document. With `likely`, items go of
        which too few words occur in the blocks around, so that no subsequence can be long enough."""
        n = np.array([-(-len(t) // BLOCK) for t in docs], np.int64)
        start = np.concatenate([[0], np.cumsum(n)])
        f = [self.lex.features(t) for t in docs]
        block = np.concatenate([np.arange(len(x)) // BLOCK + a for x, a in zip(f, start)])
        f = np.concatenate(f)
        block, f = block[f >= 0], f[f >= 0]
        if not len(f):
            return
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sums = np.zeros((start[-1] + 1, self.space.shape[1]), np.float32)
        sums[block[first] + 1] = runs_summed(self.space, f, first)
        total = np.cumsum(sums, axis=0, dtype=np.float64)
        many = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=start[-1]))])
        doc = np.repeat(np.arange(len(docs)), n)
        begin, end = start[doc], start[doc + 1]
        held: dict[int, np.ndarray] = {}
        # Places of an item whose word is somewhere in the document.
        known = np.zeros((len(docs), len(self.least)), np.int32)
        if likely:
            size = len(self.starts)
            word = np.unique(doc[block] * size + f)
            row, entry = self.items_of(word % size)
            np.add.at(known.ravel(), word[row] // size * known.shape[1] + self.item_of[entry], self.times[entry].astype(np.int32))
        for run in RUNS:
            lo = np.arange(start[-1])
            hi = np.minimum(lo + run, end)
            live = ((lo + run <= end) | (lo == begin)) & (many[hi] > many[lo])
            lo, hi = lo[live], hi[live]
            z = (total[hi] - total[lo]).astype(np.float32)
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)
            for k, at in ((k, at) for k in range(0, len(self.items), ITEMS) for at in range(0, len(z), PASSAGES)):
                product = z[at : at + PASSAGES] @ self.items[k : k + ITEMS].T
                p, i = np.nonzero(product >= self.cosine * norm[at : at + PASSAGES, None])
                p += at
                if likely and len(p):
                    some = known[doc[lo[p]], k + i] >= self.least[k + i]
                    p, i = p[some], i[some]
                if likely and len(p):
                    if k not in held:
                        held.clear()  # of one part of the items at a time
                        held[k] = np.zeros((start[-1] + 1, product.shape[1]), np.int32)
                        row, entry = self.items_of(f)
                        in_block, with_item = block[row], self.item_of[entry]
                        own = (with_item >= k) & (with_item < k + ITEMS)
                        np.add.at(held[k].ravel(), (in_block[own] + 1) * product.shape[1] + with_item[own] - k, np.int32(1))
                        held[k].cumsum(0, dtype=np.int32, out=held[k])
                    around = -(-self.reach[k + i] // BLOCK)
                    a, b = np.maximum(lo[p] - around, begin[lo[p]]), np.minimum(hi[p] + around, end[lo[p]])
                    some = held[k][b, i] - held[k][a, i] >= self.least[k + i]
                    p, i = p[some], i[some]
                if len(p):
                    base = begin[lo[p]]
                    yield doc[lo[p]], k + i, product[p - at, i] / norm[p], (lo[p] - base) * BLOCK, (hi[p] - base) * BLOCK

    def candidates(self, docs: list[list[str]], likely: bool = False) -> list[dict[int, tuple[float, list[tuple[int, int]]]]]:
        """Of each document, item -> (best cosine, ranges of words) of all passages that are close enough to it."""
        found: list[dict] = [{i: (0.0, [(0, len(t))]) for i in self.whole} for t in docs]
        for arrays in self.close(docs, likely):
            for d, i, c, a, b in zip(*(x.tolist() for x in arrays)):
                best, ranges = found[d].setdefault(i, (0.0, []))
                found[d][i] = max(best, c), ranges
                ranges.append((a, b))
        return found

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """Of each text, (item_id, cosine, lcs, answer) of each item that it contains; small texts are searched together."""
        out: list[list] = []
        docs: list[list[str]] = []
        weight = 0
        for t in texts:
            docs.append(words_of(t))
            weight += len(docs[-1])
            if weight >= TOGETHER:
                out += map(self.checked, docs, self.candidates(docs, True))
                docs, weight = [], 0
        return out + list(map(self.checked, docs, self.candidates(docs, True) if docs else []))

    def checked(self, tokens: list[str], candidates: dict[int, tuple[float, list[tuple[int, int]]]]) -> list[tuple[int, float, float, float]]:
        out = []
        for i, (cosine, ranges) in sorted(candidates.items()):
            masks, size, reach = self.masks[i], len(self.lex.content[i]), int(self.reach[i])
            must, best, answer, done = self.loose * size, 0.0, 0.0, -1
            for a, b in sorted(set(ranges)):
                if b <= done:
                    continue  # within the passage before
                part = tokens[max(0, a - reach) : b + reach]
                done = b
                there = masks.keys() & part
                # No subsequence is longer than the item's places of words that are there.
                if size - len(masks) + len(there) < must or sum([masks[w].bit_count() for w in there]) < must:
                    continue
                lcs = common_subsequence(masks, part, self.full[i]) / size
                if lcs > best:
                    best, answer = lcs, sum(w in there for w in self.lex.answer[i]) / len(self.lex.answer[i])
            if best >= self.near or (best >= self.loose and answer >= 0.75):
                out.append((self.lex.ids[i], cosine, best, answer))
        return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, near: float = 0.8, loose: float = 0.6, rank: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) of every document and item that it contains.

    The benchmark is a stated set of queries, of which each task holds QUERIES at a time; for each such block documents are
    read twice and never shuffled."""
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct().collect()]
    blocks = [sorted(items)[k : k + QUERIES] for k in range(0, max(1, len(items)), QUERIES)]
    return reduce(DataFrame.unionByName, (contained(docs, b, cosine, near, loose, rank, id_col, text_col) for b in blocks))


def contained(docs: DataFrame, items: list[tuple[int, str]], cosine: float, near: float, loose: float, rank: int, id_col: str, text_col: str) -> DataFrame:
    """decontaminate() for one block of items."""
    spark = docs.sparkSession
    ddl = "doc_id long, item_id long, cosine double, lcs double, answer double"
    known = sorted({w for _, t in items for w in words_of(t)})
    if not known:
        return spark.createDataFrame([], ddl)
    scratch = Scratch(spark, "passages")
    passages = scratch.put("words", passage_words(docs, known, text_col))
    lexicon = Lexicon(items, *document_frequency(passages, known))
    space = fit_space(passages, known, lexicon, rank) if lexicon.feature else np.zeros((0, 1), np.float32)
    scratch.drop("words")
    shared = spark.sparkContext.broadcast((lexicon, space))

    def searched(batches):
        searcher = Searcher(*shared.value, cosine, near, loose)
        for b in batches:
            out = []
            for k in range(0, b.num_rows, 500):
                found = searcher.matches(b.columns[1][k : k + 500].to_pylist())
                out += [(i, *m) for i, found in zip(b.columns[0][k : k + 500].to_pylist(), found) for m in found]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 2 + [pa.float64()] * 3)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(searched), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, with or without an id: what a row contains hangs on its text alone."""
    key = f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    leaked = cut(decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct())
    return by_ids(keyed, leaked, key, "left_anti").drop(key)
