"""References against a plain search, and what their texts cost."""

import re

from corpusloom.operators import joins as J


def test_titles_are_found_without_copies_of_the_text(spark):
    titles = {1: "an extraordinarily longwinded heading", 2: "an extraordinarily longwinded heading of seven words", 3: "threewords aretwentytwo characters", 4: "double  spaced title words here", 5: "short one", 6: "an extraordinarily longwinded heading", 7: "anextraordinarilylongword", 8: None}
    raws = {
        1: "see an extraordinarily longwinded heading", 2: "an extraordinarily longwinded heading of seven words, x an extraordinarily longwinded heading of seven words", 3: "a threewords aretwentytwo characters", 4: "double  spaced title words here",
        5: "double spaced title words here short one", 6: None, 7: "", 8: "xan extraordinarily longwinded heading", 9: "anextraordinarilylongword",
    }
    library = spark.createDataFrame([(k, f"d{k}", f"a{k}", t) for k, t in titles.items()], "paper_id bigint, doi string, arxiv_id string, title_key string")
    asked = [(k, None, None, t) for k, t in raws.items()] + [(10, "d7", "a1", raws[1]), (11, "none", "a4", raws[1])]
    found = J.match_references(spark.createDataFrame(asked, "ref_id bigint, doi string, arxiv_id string, raw string"), library)
    want = {10: (7, 1), 11: (4, 2)}
    for k, t in raws.items():
        fits = [(-len(x), p) for p, x in titles.items() if x and len(x) >= 20 and f" {x} " in f" {t} "] if t is not None else []
        if fits:
            want[k] = (min(fits)[1], 3)
    assert {r.ref_id: (r.paper_id, r.rank) for r in found.collect()} == want
    kept = re.findall(r"Generate explode\(.*\), \[([^\]]*)\], (?:true|false), \[lead#", found._jdf.queryExecution().executedPlan().toString())
    assert kept and all("raw" not in k for k in kept)
