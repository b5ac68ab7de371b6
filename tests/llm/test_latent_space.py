"""The latent space is that of all passages of all documents, whichever way their products are summed."""

import random

import numpy as np

from corpusloom.llm import decontaminate as D


def test_space_of_all_passages(spark, monkeypatch):
    r, monthly = random.Random(7), "january february march april may june july august september october november december".split()
    items = [(k, " ".join(r.sample(monthly, 6))) for k in range(5)]
    texts = [" ".join(r.choice(monthly if r.random() < 0.1 else ["and", "so", "it", "went"]) for _ in range(r.choice([5, 30, 150]))) for _ in range(4300)] + [None, ""]
    monkeypatch.setattr(D, "COMMON", 2.0)
    known = sorted({w for _, t in items for w in D.words_of(t)})
    passages = D.passage_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), known, "text").cache()
    df, n = D.document_frequency(passages, known)
    assert n == len(texts) and df == {w: sum(w in D.words_of(t) for t in texts) for w in known}
    lexicon = D.Lexicon(items, df, n)
    rows = [lexicon.features(w)[lexicon.features(w) >= 0] for w in lexicon.content]
    for t in texts:
        f = lexicon.features(D.words_of(t))
        rows += [x[x >= 0] for x in (f[k : k + 60] for k in range(0, len(f), 60))]
    at, feature, weight = D.tfidf(rows, lexicon.idf)
    a = np.zeros((len(rows), len(lexicon.feature)))
    a[at, feature] = weight
    want = np.linalg.inv(a.T @ a)
    for dense in (D.DENSE, 0):
        monkeypatch.setattr(D, "DENSE", dense)
        monkeypatch.setattr(D, "SUMS", 40)
        monkeypatch.setattr(D, "ENTRIES", 64)
        space = D.fit_space(passages, known, lexicon)
        np.testing.assert_allclose(space @ space.T, want, rtol=2e-3, atol=2e-3 * np.abs(want).max())
