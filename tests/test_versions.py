"""Suggested replacements by names and texts against a plain version."""

import pytest

from corpusloom.operators import versions as V


@pytest.mark.parametrize("name,want", [
    ("Policy v2.10.pdf", ("policy", 0, [2, 10], 0, False)), ("policy_2024_ver3.docx", ("policy", 2024, [3], 0, False)), ("Policy rev B (2).pdf", ("policy", 0, [], 2, True)), ("Policy - Copy.pdf", ("policy", 0, [], 0, True)),
    ("Manual revision 12.txt", ("manual", 0, [], 12, False)), ("report2019b.csv", ("report b", 2019, [], 0, False)), ("Level5.pdf", None), ("v2.pdf", None), (None, None), ("driver7.pdf", None),
])
def test_names(spark, name, want):
    r = V.file_versions(spark.createDataFrame([(1, name)], "document_id bigint, filename string")).first()
    assert (None if not r.cue else (r.stem, r.year, r.version, r.rev, r.is_copy)) == want


def test_suggestions(spark):
    text = "An opening text of some length that is the same in both of these documents, word for word."
    rows = [
        (1, "Policy v1.pdf", "2024-01", None), (2, "policy_v2.docx", "2024-02", None), (3, "Policy.pdf", "2023-01", None), (4, "Policy (1).pdf", "2024-03", None), (5, "Other 2020.pdf", "2024-01", None), (6, "Guide 2020.pdf", "2024-01", None),
        (7, "Guide 2021.pdf", "2020-01", None), (8, "Guide 2019.pdf", "2020-01", 7), (9, "a.txt", "2024-01", None), (10, "b.txt", "2024-05", None), (11, "c.txt", "2024-02", None), (12, None, None, None), (13, "Plan copy.pdf", "2022", None), (14, "Plan.pdf", "2023", None),
    ]
    documents = spark.createDataFrame(rows, "document_id bigint, filename string, uploaded_at string, superseded_by bigint")
    texts = spark.createDataFrame([(9, text), (10, text.upper() + "!"), (11, "short"), (12, "short"), (1, text + " more")], "document_id bigint, text string")
    got = {(r.document_id, r.replaced_by): r.reason for r in V.suggested_replacements(documents, texts).collect()}
    assert got == {(1, 2): "version_in_name", (3, 2): "version_in_name", (2, 4): "copy_of", (6, 7): "version_in_name", (9, 10): "same_text", (13, 14): "copy_of"}


def test_numbers_of_documents_are_no_years(spark):
    """As the query's names have them from document 15,200 on: families 1899 to 2100 stay apart."""
    rows, want = [], {}
    for k, n in enumerate((1899, 1900, 1999, 2099, 2100)):
        rows += [(4 * k, f"Policy {n}.pdf"), (4 * k + 1, f"policy_{n}_2016.docx"), (4 * k + 2, f"Policy-{n} rev 2.pdf"), (4 * k + 3, f"Policy {n} v3.4.pdf")]
        rows.append((100 + k, f"note {n}x.pdf"))
        want |= {4 * k: 4 * k + 1, 4 * k + 2: 4 * k + 1, 4 * k + 3: 4 * k + 1}
    documents = spark.createDataFrame([(i, n, "2024-01", None) for i, n in rows], "document_id bigint, filename string, uploaded_at string, superseded_by bigint")
    got = {r.document_id: (r.replaced_by, r.reason) for r in V.suggested_replacements(documents, numbered=("policy", "note")).collect()}
    assert got == {k: (v, "version_in_name") for k, v in want.items()}
