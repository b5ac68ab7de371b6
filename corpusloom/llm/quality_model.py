"""Operator 6, quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a vector of statistics; cosines of random projections approximate a Gaussian kernel over them. The
normal equations are sums over rows, so each partition adds up its own and the driver solves one small system. Scores
are calibrated on labelled rows that the fit has not seen.

Defined cases: a null or empty text is scored like any other, from statistics that are all zero; labels that are null
are ignored, repeated ones averaged; without labels every score is 0.5; equal rows score alike; extra columns are
ignored."""

from __future__ import annotations

import hashlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.calibration import Isotonic
from corpusloom.llm.common import cut, table, words

STATISTICS = 24
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_HIGH = _BYTES >= 128
_END = np.isin(_BYTES, list(b".?!"))
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>{}[]=+~^@_\\/"))
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT


def statistics(text: str | None) -> list[float]:
    """The document statistics of one text: sizes, character classes, repetition, words and lines."""
    tokens = words(text)
    n = len(tokens)
    if not n:
        return [0.0] * STATISTICS
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    share = lambda mask: float(hist[mask].sum()) / size
    lens = np.fromiter(map(len, tokens), np.float64, n)
    counts = Counter(tokens)
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    top = counts.most_common(10)
    ends = Counter(t[-1:] for t in tokens)
    letters = max(1, int(hist[_UPPER | _LOWER | _HIGH].sum()))
    return [
        np.log1p(n), np.log1p(len(full)), float(lens.mean()), float(lens.std()), np.log(float(lens.max())),
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_PUNCT), share(_END), share(_HIGH), float(hist[_UPPER].sum()) / letters,
        len(counts) / n, len(counts) / n**0.8, top[0][1] / n, sum(c for _, c in top) / n, sum(map(eq, tokens, tokens[1:])) / n,
        len(set(full)) / max(1, len(full)), n / max(1, len(full)) / 100, float((lens <= 3).mean()), float((lens == 1).mean()),
        ends[b"."] / n, sum(ends[bytes([c])] for c in b"!?|#*$%&;:") / n, sum(c == 1 for c in counts.values()) / n,
    ]


class Model:
    """Standardised statistics -> random Fourier features -> ridge score -> probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.calibrate = Isotonic(np.array([]), np.array([]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5) @ self.w + self.b
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrate(self.lift(x) @ self.beta)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text) of the `sample` labelled documents that come first by a hash of their id, one row per id."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")


def fold(column: str = "doc_id", of: int = 5):
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 30_000, features: int = 384, width: float = 4.0, ridge: float = 1e-3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `sample` of the given labelled rows (a documented bound); a fifth of them only calibrates.

    The sample's statistics are written once; partial normal equations come from at most 16 partitions."""

    def measured(batches):
        for b in batches:
            x = [statistics(t) for t in b.columns[2].to_pylist()]
            own = [hashlib.md5(str(i).encode()).digest()[0] % 5 == 0 for i in b.columns[0].to_pylist()]
            yield pa.record_batch([b.columns[1], pa.array(own, pa.bool_()), pa.array(x, pa.list_(pa.float64()))], names=["y", "own", "x"])

    rows = cut(labelled(docs, labels, label, sample, id_col, text_col).mapInArrow(measured, "y double, own boolean, x array<double>").coalesce(16))
    one = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not one:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), features, width, seed)
    scale = np.array([r.s for r in one])
    model = Model(np.array([r.m for r in one]), np.where(scale > 1e-9, scale, 1.0), features, width, seed)

    def summed(batches):
        a, c = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for b in batches:
            y, own, x = (b.columns[k].to_pylist() for k in range(3))
            keep = ~np.array(own, bool)
            z = model.lift(np.array(x, float).reshape(-1, STATISTICS)[keep])
            a += z.T @ z
            c += z.T @ np.array(y, float)[keep]
        yield pa.record_batch([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["a", "c"])

    a, c = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
    for r in rows.mapInArrow(summed, "a binary, c binary").toLocalIterator():
        a += np.frombuffer(bytes(r.a)).reshape(a.shape)
        c += np.frombuffer(bytes(r.c))
    n = max(1.0, a[-1, -1])
    model.beta = np.linalg.solve(a / n + ridge * np.eye(features + 1), c / n)
    held = rows.filter("own").select("y", "x").collect()
    if held:
        x = np.array([r.x for r in held], float).reshape(-1, STATISTICS)
        model.calibrate = Isotonic(model.lift(x) @ model.beta, np.array([r.y for r in held]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document; a map, the model being some 100 KB."""

    def scored(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                x = np.array([statistics(t) for t in b.columns[1][k : k + 500].to_pylist()], float).reshape(-1, STATISTICS)
                yield pa.record_batch([b.columns[0][k : k + 500], pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scored, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(fold() != 0))
    return score(docs, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
