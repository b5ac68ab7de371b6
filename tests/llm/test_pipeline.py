"""The pipeline against a plain run of the same stages, one document at a time."""

import random

import corpus_pipeline
from corpusloom.llm import quality_rules
from tests.llm.test_operators import brute_components, brute_lines

R = random.Random(8)


def prose(n: int, tag: str) -> str:
    return " ".join(f"{tag}{R.randrange(10**6)}" for _ in range(n))


def test_pipeline(spark, tmp_path):
    item = prose(40, "i")
    texts = {k: "\n".join(prose(20, "w") for _ in range(3)) for k in range(20)}
    texts[20] = texts[3]  # an exact copy
    texts[21] = "too short"
    texts[22] = prose(30, "w") + " " + item + " " + prose(30, "w")
    texts[23] = texts[4].split("\n")[0] + "\n" + prose(60, "w")
    texts[24] = texts[5] + "\nfour words are left"  # kept, though nearly all of it goes
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {k: t for k, t in texts.items() if quality_rules.measure(t)[0] >= 20}
    gone = brute_lines(kept.items())
    left = {}
    for k, t in kept.items():
        new = "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in gone)
        if new.strip() or new == t:
            left[k] = new
    left = {k: t for k, t in left.items() if brute_components(left.items())[k][1] == k}
    left.pop(22)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(left) == set(range(20)) | {23, 24}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontaminate", "bpe"]


def test_rarity_is_small_in_plans(spark):
    """Plans hold the counts of words as text, and Spark keeps the text of each plan on the driver."""
    from corpusloom.llm import line_dedup

    docs = spark.createDataFrame([(1, "one word and another\nand one")], "doc_id long, text string")
    assert len(",".join(map(str, line_dedup.rarity(docs, "text")))) < 64_000
