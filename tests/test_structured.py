"""Structured chunks and quote checks against plain versions."""

import difflib
import random
import re

import pytest

from corpusloom.operators import grounding as G
from corpusloom.operators import structured as T
from corpusloom.operators.segment import windows

PROSE = "The pump moves water to the tank. It stops when the level is high. "
R = random.Random(4)


def make_page(k: int) -> str:
    parts = []
    for _ in range(R.randint(0, 6)):
        kind = R.randint(0, 6)
        parts.append([
            "Safety Notes", "3.2 Checks", "OVERVIEW", PROSE * R.randint(1, 4), "1. Open the valve\nslowly\n2. Close it\n3) Wait", "- one thing\nand more", PROSE[: R.randint(5, 60)] + "\nsecond line " + "word " * R.randint(0, 150),
        ][kind])
    return R.choice(["\n\n", "\n \n"]).join(parts) + R.choice(["", "\n", " and then", "  "])


DOCUMENTS = {d: [make_page(k) for k in range(R.randint(1, 6))] for d in range(40)}
DOCUMENTS[90] = ["The rest of this sentence", "is here. And more", "goes on\n\nafter a gap. End", "Safety Notes\nbody", None, "x" * 3000, ""]
DOCUMENTS[91] = ["open page one", "all of this page.", "next page here. Yes", "Heading Line\n\n" + "w " * 10, "plain text goes under it, and is long enough. " * 40]


def plain_pages(pages):
    """Sentences finished one pair of pages after the other, on lists."""
    pages = [p or "" for p in pages]
    for k in range(1, len(pages)):
        before, after = pages[k - 1], pages[k]
        if not before.strip() or not after.strip() or re.search(r"[.!?:;)\]\"'”’]\s*$", before):
            continue
        top = after.lstrip()
        if T.is_heading(top.split("\n")[0].strip()):
            continue
        m = re.match(r"(?s)(.{1,400}?[.!?][\"'”’)]?)(?=\s|$)", top)
        if m and "\n\n" not in m[1]:
            pages[k - 1], pages[k] = before.rstrip() + " " + m[1].strip(), top[m.end() :].lstrip()
    return pages


def plain_chunks(pages, size, overlap, continuous):
    """Chunk texts of a document: headings looked up from the start of the document for each block."""
    pages = plain_pages(pages) if continuous else [p or "" for p in pages]
    out, carried = [], None
    for text in pages:
        split = [b.strip() for b in re.split(r"\n\s*\n+", text) if b.strip()]
        bodies = [[x.strip() for x in b.split("\n") if x.strip()] for b in split]
        heads = [len(b) == 1 and T.is_heading(b[0]) for b in bodies]
        first = carried if continuous else None
        if text.strip():
            lead = text.lstrip().split("\n\n")[0].strip()
            start = None if "\n" not in lead and T.is_heading(lead) else first
            if len(text) <= size:
                out.append((f"{start}\n" if start else "") + text)
            else:
                segs = []
                for k, b in enumerate(bodies):
                    if heads[k]:
                        continue
                    above = [bodies[j][0] for j in range(k) if heads[j]]
                    head = above[-1] if above else start
                    marks = [bool(re.match(r"(?i)((step\s+)?\d+[).:-]|[a-z][).]|[-*])\s+\S", x)) for x in b]
                    if sum(marks) >= 2 or (sum(marks) == 1 and len(b) <= 4 and len("\n".join(b)) <= size):
                        groups = []
                        for x, mark in zip(b, marks):
                            groups.append([x]) if mark or not groups else groups[-1].append(x)
                        bits = ["\n".join(g) for g in groups]
                    else:
                        bits = ["\n".join(b)]
                    segs += [f"{head}\n{x}" if head and not x.startswith(head) else x for x in bits]
                done, buffer = [], []
                for s in segs if len(segs) > 1 else []:
                    if len(s) > size:
                        done += ["\n\n".join(buffer).strip()] if buffer else []
                        buffer = []
                        done += windows(s, size, overlap)
                    elif buffer and len("\n\n".join(buffer + [s]).strip()) > size:
                        done.append("\n\n".join(buffer).strip())
                        tail = buffer[-1].strip()
                        tail = tail if len(tail) <= max(overlap, 120) else tail[-overlap:].strip()
                        if tail and overlap and len(f"{tail}\n\n{s}") > size:
                            done.append(tail)
                            buffer = [s]
                        else:
                            buffer = ([tail] if tail and overlap else []) + [s]
                    else:
                        buffer.append(s)
                done += ["\n\n".join(buffer).strip()] if buffer else []
                done = [c for c in done if c]
                if not done:
                    done = windows(text, size, overlap)
                    if start and done:
                        done[0] = f"{start}\n{done[0]}"
                out += done
        found = [b[0] for b, h in zip(bodies, heads) if h]
        carried = found[-1] if found else carried
    return out


def pages_frame(spark):
    rows = [(d, k + 1, p) for d, pages in DOCUMENTS.items() for k, p in enumerate(pages)]
    return spark.createDataFrame(rows, "document_id bigint, page_number int, text string").repartition(5)


@pytest.mark.parametrize("size,overlap,continuous", [(600, 100, True), (200, 0, True), (300, 150, False)])
def test_chunks_equal_the_plain_version(spark, size, overlap, continuous):
    got = T.structured_chunks(pages_frame(spark), size, overlap, continuous).collect()
    for d, pages in DOCUMENTS.items():
        mine = [r.text for r in sorted((r for r in got if r.document_id == d), key=lambda r: (r.page_number, r.chunk_index))]
        assert mine == plain_chunks(pages, size, overlap, continuous), d
    assert len({r.chunk_id for r in got}) == len(got)
    with pytest.raises(ValueError):
        T.structured_chunks(pages_frame(spark), 100, 100)


def test_pages_are_stitched(spark):
    got = T.stitched(pages_frame(spark)).collect()
    for d, pages in DOCUMENTS.items():
        assert [r.text for r in sorted((r for r in got if r.document_id == d), key=lambda r: r.page_number)] == plain_pages(pages), d


@pytest.mark.parametrize("line,yes", [("# Any", True), ("Chapter on pumps and their many long tubes", True), ("2.1 Pump", True), ("IV. Results", True), ("ALL CAPITALS HERE", True), ("The Pump Station", True), ("The Pump, Station", False), ("a plain line", False), ("Abc", False), ("The Pump Station.", False), ("Title:", True), ("x " * 13, False)])
def test_headings(line, yes):
    assert T.is_heading(line) is yes


# ---- ordered overlap


def by_definition(needle, text):
    """difflib over whole texts."""
    a, b = G.compact(needle), G.compact(text)
    if not a or not b:
        return 0.0
    if a in b:
        return 1.0
    block = difflib.SequenceMatcher(None, b, a, autojunk=False).find_longest_match(0, len(b), 0, len(a))
    if not block.size:
        return 0.0
    start = max(0, block.a - block.b - 10)
    found = [m for m in difflib.SequenceMatcher(None, b[start : start + len(a) + 20], a, autojunk=False).get_matching_blocks() if m.size]
    return sum(m.size for m in found) / max(len(a), found[-1].a + found[-1].size - found[0].a)


def test_similarity_equals_difflib():
    r = random.Random(8)
    words = ["pump", "valve", "a", "leak", "40", "bar", "not", "red", "ab", "aba"]
    for _ in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        quote = " ".join(r.choice(words) for _ in range(r.randint(0, 12))) if r.random() < 0.5 else text[r.randint(0, 20) : r.randint(20, 60)].replace(r.choice("abe"), r.choice(["", "x"]), 1)
        assert G.similarity(quote, text) == by_definition(quote, text), (quote, text)


def test_longest_common_substring():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        m = difflib.SequenceMatcher(None, b, a, autojunk=False).find_longest_match(0, len(b), 0, len(a))
        assert G.Automaton(a).longest(b) == (m.a, m.b, m.size) or not m.size


PASSAGE = "In our trials the new pump did not recover after the valve was closed at 40 bar, and the second motor ran for 12 hours without any leak."


@pytest.mark.parametrize("quote,verdict", [
    ("the new pump did not recover after the valve was closed", "exact"), ("The new pump did NOT re-\ncover after the valve was closed", "exact"), ("new pump did recover after", "missing"), ("new pump did not recover after", "exact"),
    ("the new pump did not recover ... the second motor ran for 12 hours", "exact"), ("the second motor ran … the new pump did not recover", "exact"), ("the new pump did not recover aftr the valve was closd", "fuzzy"),
    ("valve was closed at 41 bar, and the second motor ran", "missing"), ("the valve was closed after the new pump did not recover", "missing"), ("the new pump", "missing"), ("", "missing"),
])
def test_verdicts(quote, verdict):
    assert G.verify_quote(quote, {"p": PASSAGE, "q": "other words of another kind"}, "p")[0] == verdict


def test_statements(spark):
    passages = spark.createDataFrame([(1, "p1", PASSAGE), (1, "p2", "Nothing of the kind is printed here."), (2, "p1", "The second motor ran for 12 hours without any leak."), (1, "p3", PASSAGE + " More.")], "source_id bigint, passage_id string, text string")
    rows = [(1, 1, "did not recover after the valve was closed", "p1"), (2, 1, "did not recover after the valve was closed", "p2"), (3, 2, "did not recover after the valve was closed", "p1"), (4, 1, "", "p1"), (5, 1, None, None), (6, 2, "the second motor ran for 12 hours", None), (7, 9, "the second motor ran for 12 hours", "p1")]
    got = G.verified_statements(spark.createDataFrame(rows, "statement_id bigint, source_id bigint, quote string, passage_id string"), passages).collect()
    assert {r.statement_id: (r.verdict, r.passage_id) for r in got} == {1: ("exact", "p1"), 2: ("relocated", "p1"), 3: ("missing", None), 4: ("rejected", None), 5: ("rejected", None), 6: ("relocated", "p1"), 7: ("missing", None)}


def test_titles(spark):
    asked = spark.createDataFrame([(1, "A. Smith. On the flow of steam in pipes. 2020."), (2, "Other text")], "ref_id bigint, text string")
    offered = spark.createDataFrame([(1, "On the Flow of Steam in Pipes"), (1, "Another title of things"), (2, "On the Flow of Steam in Pipes")], "ref_id bigint, title string")
    assert [tuple(r)[:2] for r in G.same_titles(asked, offered).collect()] == [(1, "On the Flow of Steam in Pipes")]


@pytest.mark.parametrize("answer,reasons", [
    ("The pump ran at 40 bar [Source 1].", []), ("The pump ran at 41 bar [Source 1].", [("not_in_passage", ["41"])]), ("It ran twelve hours, 12 in all [Source 1].", []), ("No citation of 99.", []),
    ("It ran [Source 3].", [("no_such_source", ["Source 3"])]), ("As page 7 of manual.pdf says it ran [Source 1].", []), ("1. It took 1,000 s [Source 2].", []), ("Twice in March, on 2024-03-05 [Source 2].", []),
    ("Unit PX-200 said “no leak” [Source 1, Source 2].", [("not_in_passage", ["PX-200", "“no leak”"])]), ("It ran 40 h [Source 1]. And 41 h [Source 1] or 2 [Source 2].", [("not_in_passage", ["41"]), ("not_in_passage", ["41"])]),
])
def test_answer_failures(answer, reasons):
    sources = ["The pump ran at 40 bar for twelve hours, 40 h and 2.", "It took 1000 s on 5 March 2024, twice."]
    assert [(f["reason"], f["missing"]) for f in G.answer_failures(answer, sources)] == reasons


def test_failures_as_a_column(spark):
    rows = spark.createDataFrame([(1, "It is 41 [Source 1].", ["It is 40."]), (2, None, None)], "id bigint, answer string, sources array<string>")
    assert {r.id: len(r.f) for r in rows.select("id", G.failures("answer", "sources").alias("f")).collect()} == {1: 1, 2: 0}
