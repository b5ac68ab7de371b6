"""Operator 4, toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The index holds, for each term, its examples in blocks of ids with the largest weight of each block. A query adds up
those maxima into an upper bound for each block, scores the blocks with the largest bounds and then those whose bound
the k-th best cosine so far does not exceed, so the neighbours are exact. Votes weighted by similarity are calibrated on labelled rows
that are not in the index; the neighbours are returned as evidence.

A term's inverse document frequency is multiplied by how far the labels depend on the term, since chance words would
otherwise outweigh the few that matter (with plain weights a third of the toxic documents of the test tables are missed).

Defined cases: a null or empty text, or one without an indexed term, gets the vote of no neighbour, which calibration
turns into the rate among such texts; null labels are ignored, repeated ones averaged; of equal cosines the example
that comes first in the index counts; without labels every score is 0.5; equal rows score alike; extra columns are
ignored."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.calibration import Isotonic
from corpusloom.llm.common import table
from corpusloom.llm.quality_model import fold

TERM = re.compile(r"\w+")
STEMS = (5, 7)


def terms(text: str | None) -> Counter:
    """Words and, for inflected forms, the stems of 5 and 7 letters that longer words begin with."""
    found = Counter(TERM.findall(text.lower())) if text else Counter()
    short, long = STEMS
    seen, get = list(found.items()), found.get
    for w, c in seen:
        if len(w) > short:
            stem = w[:short] + "-"
            found[stem] = get(stem, 0) + c
            if len(w) > long:
                stem = w[:long] + "-"
                found[stem] = get(stem, 0) + c
    return found


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, end), one range after another."""
    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)


class Index:
    """Examples as unit TF-IDF vectors, by term and block."""

    def __init__(self, examples: list[tuple[int, float, dict[str, int]]], block: int = 32):
        self.block = block
        df, hot = Counter(), Counter()
        for _, y, tf in examples:
            df.update(tf.keys())
            if y >= 0.5:
                hot.update(tf.keys())
        n, toxic = max(1, len(examples)), max(1, sum(y >= 0.5 for _, y, _ in examples))
        self.vocabulary, weights = {}, []
        for t, d in sorted(df.items()):
            if d == n:
                continue  # its weight is 0
            p = toxic / n
            z = (hot[t] - d * p) / np.sqrt(d * p * (1 - p) * (1 - d / n) + 1e-9)
            relevance = 1.0 if z >= 5 and d > 1 else 0.02  # one example shows no dependence
            self.vocabulary[t] = len(self.vocabulary)
            weights.append(np.log(n / d) * relevance)
        self.idf = np.array(weights)
        # Examples that share their heaviest term stand together, so that a block's maxima are close to its members.
        vectors = [(self.vector(tf), i, y) for i, y, tf in examples]
        vectors.sort(key=lambda v: (int(v[0][0][np.argmax(v[0][1])]) if len(v[0][0]) else -1, v[1]))
        self.ids = np.array([i for _, i, _ in vectors], np.int64)
        self.labels = np.array([y for _, _, y in vectors], float)
        term = np.concatenate([v[0][0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        self.example = np.repeat(np.arange(len(vectors)), [len(v[0][0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
        self.value = np.concatenate([v[0][1] for v in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((self.example, term))
        term, self.example, self.value = term[order], self.example[order].astype(np.int32), self.value[order]
        blocks = self.example // block
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.pair_start = first
        self.pair_end = np.append(first[1:], len(term))
        self.pair_block = blocks[first]
        self.pair_max = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.term_pairs = np.searchsorted(term[first], np.arange(len(self.vocabulary) + 1))
        self.term, self.dense = term, None

    def __getstate__(self):
        return {**self.__dict__, "dense": None}  # each process makes the matrices anew

    def matrices(self) -> None:
        """Postings of terms that stand in a third of the blocks, as matrices; all others stay lists of pairs."""
        size = len(self.labels)
        self.n_blocks = -(-size // self.block)
        wide = np.flatnonzero(np.diff(self.term_pairs) >= max(2, self.n_blocks // 3))
        self.wide = np.full(len(self.vocabulary), -1)
        self.wide[wide] = np.arange(len(wide))
        column = self.wide[self.term]
        self.dense = np.zeros((size, len(wide)), np.float32)
        self.dense[self.example[column >= 0], column[column >= 0]] = self.value[column >= 0]
        self.dense_max = np.zeros((len(wide), self.n_blocks), np.float32)
        column = self.wide[self.term[self.pair_start]]
        self.dense_max[column[column >= 0], self.pair_block[column >= 0]] = self.pair_max[column >= 0]

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of unit length; a term counts 1 + log of its frequency."""
        at = np.fromiter(map(self.vocabulary.get, tf, repeat(-1)), np.int64, len(tf))
        w = 1 + np.log(np.fromiter(tf.values(), float, len(tf)))
        w, at = w[at >= 0], at[at >= 0]
        w = w * self.idf[at]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def nearest(self, tfs: list[dict[str, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query, (positions, cosines) of the k nearest examples with a positive cosine, exact.

        Blocks with the largest bounds are scored first; then all those whose bound reaches the k-th best cosine so far."""
        if self.dense is None:
            self.matrices()
        n, n_blocks, size = len(tfs), self.n_blocks, len(self.labels)
        if not size:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        vectors = [self.vector(tf) for tf in tfs]
        query = np.repeat(np.arange(n), [len(at) for at, _ in vectors])
        at, w = (np.concatenate(x) for x in zip(*vectors))
        column = self.wide[at]
        dense = np.zeros((n, len(self.dense_max)), np.float32)
        dense[query[column >= 0], column[column >= 0]] = w[column >= 0]
        query, at, w = query[column < 0], at[column < 0], w[column < 0]
        a, b = self.term_pairs[at], self.term_pairs[at + 1]
        pairs = spans(a, b)
        weight, query = np.repeat(w, b - a), np.repeat(query, b - a)
        cell = query * n_blocks + self.pair_block[pairs]
        bound = dense @ self.dense_max + np.bincount(cell, weight * self.pair_max[pairs], n * n_blocks).reshape(n, n_blocks)
        scores = np.zeros((n, size))
        least = np.full(n, 0.0)
        # As many blocks as hold eight times the wanted neighbours, then what the k-th best of those cannot rule out.
        some = min(n_blocks, max(1, -(-8 * k // self.block)))
        taken = bound >= np.partition(bound, n_blocks - some, axis=1)[:, n_blocks - some, None]
        done = np.zeros_like(taken)
        for last in (False, True):
            fresh = taken & ~done & (bound > 0)
            for j in np.flatnonzero(fresh.any(0)).tolist():
                rows = np.flatnonzero(fresh[:, j])
                here = self.dense[j * self.block : (j + 1) * self.block]
                scores[rows, j * self.block : (j + 1) * self.block] = dense[rows] @ here.T
            chosen = fresh.ravel()[cell]
            p, q = pairs[chosen], weight[chosen]
            sizes = self.pair_end[p] - self.pair_start[p]
            entries = spans(self.pair_start[p], self.pair_end[p])
            scores += np.bincount(np.repeat(query[chosen], sizes) * size + self.example[entries], np.repeat(q, sizes) * self.value[entries], n * size).reshape(n, size)
            if not last:
                done |= fresh
                if k < size:
                    least = np.partition(scores, size - k, axis=1)[:, size - k]
                taken = bound >= least[:, None] - 1e-5  # more than single precision may be off
        out = []
        for row in scores:
            hit = np.flatnonzero(row > 0) if k >= size else np.flatnonzero(row >= max(np.partition(row, size - k)[size - k], 1e-300))
            top = hit[np.lexsort((hit, -row[hit]))[:k]]
            out.append((top, row[top]))
        return out

    def votes(self, tfs: list[dict[str, int]], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each query, the similarity-weighted share of toxic neighbours (-1 without neighbours), and the neighbours."""
        out = []
        for at, cos in self.nearest(tfs, k) if tfs else ():
            w = cos**2
            out.append((float((w * self.labels[at]).sum() / w.sum()) if len(at) else -1.0, at, cos))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 2000, id_col: str = "doc_id", text_col: str = "text", k: int = 15) -> tuple[Index, Isotonic]:
    """Index at most `most` examples of each label (those first by a hash of the id; a documented bound) and calibrate.

    Terms are counted on the executors; of equal texts one is used. A third of the examples only calibrates, weighted
    to the share of each label among all labelled rows."""
    each = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).alias("y"))
    rates = {r.y: r.n for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (False, True):
        part = each.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)

    def counted(batches):
        for b in batches:
            tf = [terms(t) for t in b.columns[2].to_pylist()]
            marks = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in b.columns[2].to_pylist()]
            yield pa.record_batch([b.columns[0], b.columns[1], pa.array(marks, pa.string()), pa.array([list(x) for x in tf], pa.list_(pa.string())), pa.array([list(x.values()) for x in tf], pa.list_(pa.int32()))], names=["i", "y", "mark", "t", "c"])

    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    rows = sample.mapInArrow(counted, "i long, y boolean, mark string, t array<string>, c array<int>")
    once: dict[str, tuple] = {}
    for r in rows.toLocalIterator():
        if r.mark not in once or r.i < once[r.mark][0]:
            once[r.mark] = r.i, float(r.y), dict(zip(map(sys.intern, r.t), r.c))
    parts: tuple[list, list] = ([], [])
    for mark, example in sorted(once.items()):
        parts[int(mark[:8], 16) % 3 == 0].append(example)
    index = Index(parts[0])
    raw = np.array([v for at in range(0, len(parts[1]), 64) for v, _, _ in index.votes([tf for _, _, tf in parts[1][at : at + 64]], k)])
    y = np.array([y for _, y, _ in parts[1]])
    if len(y) and 0 < y.sum() < len(y):  # as many of each label as among all labelled rows
        share = rates.get(True, 0) / max(1, sum(rates.values()))
        odds = (share / (1 - share)) / (y.mean() / (1 - y.mean())) if share < 1 else 1.0
        copies = np.where(y >= 0.5, np.clip(round(100 * odds), 1, None), 100).astype(int)
        raw, y = np.repeat(raw, copies), np.repeat(y, copies)
    return index, Isotonic(raw, y)


def score(docs: DataFrame, index: Index, calibrate: Isotonic, k: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, neighbours, cosines) of every document; a map over documents, the index (some MB) sent once."""
    shared = docs.sparkSession.sparkContext.broadcast((index, calibrate))

    def scored(batches):
        index, calibrate = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                votes = index.votes([terms(t) for t in b.columns[1][at : at + 64].to_pylist()], k)
                s = calibrate(np.array([v for v, _, _ in votes]))
                near = [index.ids[p].tolist() for _, p, _ in votes]
                yield pa.record_batch(
                    [b.columns[0][at : at + 64], pa.array(s, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array([np.round(c, 6).tolist() for _, _, c in votes], pa.list_(pa.float64()))],
                    names=["doc_id", "score", "neighbours", "cosines"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scored, "doc_id long, score double, neighbours array<long>, cosines array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index, calibrate = fit(docs, labels.filter(fold(of=4) != 2))
    out = score(docs, index, calibrate)
    return out.select("doc_id", F.coalesce(fold(of=4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours")
