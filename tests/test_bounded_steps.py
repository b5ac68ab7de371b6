"""Keywords, neighbours, Jaccard and text pieces: what is shuffled or held at once stays small, with the same results."""

import random

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedupe as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import search as S
from corpusloom.operators import segment


def test_keywords_shuffle_only_the_best(spark):
    rows = [(k, f"common common own{k} shared{k // 2} a{k % 3}xy") for k in range(30)] + [(30, None), (31, "")]
    got = E.probe_keywords(spark.createDataFrame(rows, "doc_id long, text string"), len(rows), 2)
    best = {k: {r.term for r in got.collect() if r.id == k} for k in range(30)}
    assert all(len(v) == 2 and f"own{k}" in v for k, v in best.items()) and got.count() == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    twice = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (2, "dd")], "doc_id long, text string")
    assert {(r.id, r.term) for r in E.probe_keywords(twice, 3, 1).collect()} == {(1, "bb"), (2, "dd")}


def test_neighbours_by_strips(spark, monkeypatch):
    monkeypatch.setattr(S, "STRIP_X", 7)
    monkeypatch.setattr(S, "STRIP_Y", 11)
    r = random.Random(3)
    rows = [(k, k % 4, [float(r.randint(-2, 2)) for _ in range(3)] + [1.0]) for k in range(90)]  # many equal scores
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {}
    for x in S.neighbours(frame, 3, block=40).collect():
        got.setdefault(x.id, []).append((x["rank"], x.other, x.score))
    unit = {k: [v / sum(y * y for y in e) ** 0.5 for v in e] for k, _, e in rows}
    for k, g, _ in rows:
        near = sorted((-round(sum(a * b for a, b in zip(unit[k], unit[j])), 6), j) for j, h, _ in rows if h != g)[:3]
        assert [x[1] for x in sorted(got[k])] == [j for _, j in near]


def test_jaccard_of_texts_is_that_of_their_shingles(spark):
    texts = ["a b c d e", "a b c d f", "a b", "a b a b a b", "", None, "  ", "b c d e", "é 1.5 x y"]
    rows = spark.createDataFrame([(s, t) for s in texts for t in texts], "s string, t string")
    want = T.jaccard(T.shingles(F.col("s")), T.shingles(F.col("t")))
    assert rows.select(D.shingle_jaccard("s", "t").alias("got"), want.alias("want")).filter("got <> want OR got IS NULL").count() == 0


def test_pieces_are_small_and_whole():
    s = pd.Series(range(600))
    assert [len(p) for p in segment.in_pieces([s])] == [256, 256, 88]
    assert [x for a, b in segment.in_pieces([(s, s + 1)]) for x in b] == list(range(1, 601))
