"""Chunks that follow a text's structure: headings carried along, steps kept apart, sentences finished across pages.

A document is read as one text over its pages. What a page takes from its neighbours (the rest of a cut sentence, the
heading in force) comes from window functions over a document's pages; what happens within a page is a small helper."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from corpusloom.operators.segment import in_pieces, windows

#: A page that ends like this has finished its sentence; the rest of a sentence is this much at most.
OPEN_END, REST = r"""[.!?:;)\]"'”’]\s*$""", 400
_REST = re.compile(r"""(?s)(.{1,400}?[.!?]["'”’)]?)(?=\s|$)""")
_NUMBERED = re.compile(r"(?:\d+(?:\.\d+){0,4}|[A-Z]\.|[IVXLC]+\.)\s+[A-Z]")
_NAMED = re.compile(r"(?:section|chapter|appendix|overview|introduction|summary)\b", re.I)
_STEP = re.compile(r"(?:(?:step\s+)?\d+[).:-]|[a-z][).]|[-*])\s+\S", re.I)
_BLANK = re.compile(r"\n\s*\n+")


def is_heading(line: str) -> bool:
    """Whether a line reads like a heading: 4 to 120 characters, 12 words at most, and marked, named, numbered, in
    capitals, or in title case without the end of a sentence."""
    text = line.strip().rstrip(":")
    n = len(text.split())
    if not 4 <= len(text) <= 120 or n > 12:
        return False
    if text[0] == "#" or _NAMED.match(text) or _NUMBERED.match(text) or (n <= 10 and text.isupper()):
        return True
    return n <= 8 and text == text.title() and text[-1] not in ".!?" and "," not in text


def blocks(text: str) -> list[list[str]]:
    """The blocks between blank lines, each as its stripped lines that are not empty."""
    parts = ([line.strip() for line in block.splitlines() if line.strip()] for block in _BLANK.split(text))
    return [lines for lines in parts if lines]


def last_heading(text: str) -> str | None:
    found = [lines[0] for lines in blocks(text) if len(lines) == 1 and is_heading(lines[0])]
    return found[-1] if found else None


def steps(lines: list[str], size: int) -> list[str] | None:
    """The steps of a procedural block, each with the lines under it; None if the block is prose."""
    marks = [k for k, line in enumerate(lines) if _STEP.match(line)]
    if len(marks) < 2 and not (len(marks) == 1 and len(lines) <= 4 and len("\n".join(lines)) <= size):
        return None
    cuts = [0, *[k for k in marks if k], len(lines)]
    return ["\n".join(lines[a:b]) for a, b in zip(cuts, cuts[1:])]


def segments(text: str, heading: str | None, size: int) -> list[str]:
    """Paragraphs and steps in order, each under the heading in force where it stands."""
    out = []
    for lines in blocks(text):
        if len(lines) == 1 and is_heading(lines[0]):
            heading = lines[0]
            continue
        for part in steps(lines, size) or ["\n".join(lines)]:
            out.append(f"{heading}\n{part}" if heading and not part.startswith(heading) else part)
    return out


def packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Segments joined to chunks of a size; a chunk that follows starts with the last segment, or its end, if that fits.

    A segment over the size is cut into windows of its own."""
    out: list[str] = []
    held: list[str] = []

    def close():
        if held:
            out.append("\n\n".join(held).strip())

    for part in parts:
        if len(part) > size:
            close()
            held = []
            out += windows(part, size, overlap)
            continue
        if held and len("\n\n".join([*held, part]).strip()) > size:
            close()
            last = held[-1].strip()
            seed = (last if len(last) <= max(overlap, 120) else last[-overlap:].strip()) if overlap > 0 else ""
            held = [seed] if seed else []
            if held and len(f"{seed}\n\n{part}") > size:
                close()
                held = []
        held = [*held, part]
    close()
    return [c for c in out if c]


def page_chunks(text: str, heading: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of one page under the heading that is in force where it starts."""
    if not text.strip():
        return []
    first = text.lstrip().split("\n\n", 1)[0].strip()
    if "\n" not in first and is_heading(first):
        heading = None
    if len(text) <= size:
        return [f"{heading}\n{text}" if heading else text]
    parts = segments(text, heading, size)
    if len(parts) > 1 and (out := packed(parts, size, overlap)):
        return out
    out = windows(text, size, overlap)
    return [f"{heading}\n{out[0]}", *out[1:]] if heading and out else out


def rest_of_sentence(text: str) -> str:
    """What at the top of a page may finish the sentence of the page before: up to the first sentence end, unless the
    page starts with a heading or a blank line comes first. As it stands in the text, with the space before it."""
    start = len(text) - len(text.lstrip())
    found = _REST.match(text, start)
    if not found or "\n\n" in found[1] or is_heading(text[start:].split("\n", 1)[0].strip()):
        return ""
    return text[: found.end()]


@F.pandas_udf(TY.StringType())
def _rest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in in_pieces(texts):
        yield s.map(lambda t: rest_of_sentence(t) if t else "")


@F.pandas_udf(TY.StringType())
def _last(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in in_pieces(texts):
        yield pd.Series([last_heading(t) if t else None for t in s], dtype="object")


def _strip(text: Column, side: str) -> Column:
    return F.regexp_replace(text, "^\\s+" if side == "left" else "\\s+$", "")


def stitched(pages: DataFrame) -> DataFrame:
    """pages(document_id, page_number, text) with sentences that a page break cuts finished on the page they start on.

    A page is open if it has text and does not end like a sentence. What a page gives up depends on no other page's gift:
    a page that gives all of its text ends a sentence, so it asks for nothing."""
    order = Window.partitionBy("document_id").orderBy("page_number")
    text = F.coalesce("text", F.lit(""))
    rows = pages.select("document_id", "page_number", text.alias("text")).withColumn("_open", text.rlike("\\S") & ~text.rlike(OPEN_END))
    given = F.when(F.coalesce(F.lag("_open").over(order), F.lit(False)) & F.col("text").rlike("\\S"), F.col("_rest")).otherwise("")
    rows = rows.withColumn("_rest", _rest("text")).withColumn("_given", given).withColumn("_got", F.coalesce(F.lead("_given").over(order), F.lit("")))
    own = F.when(F.col("_given") != "", _strip(F.expr("substring(text, length(_given) + 1)"), "left")).otherwise(F.col("text"))
    whole = F.when(F.col("_got") != "", F.concat(_strip(own, "right"), F.lit(" "), _strip(_strip(F.col("_got"), "left"), "right"))).otherwise(own)
    return rows.select("document_id", "page_number", whole.alias("text"))


def structured_chunks(pages: DataFrame, size: int = 600, overlap: int = 100, continuous: bool = True) -> DataFrame:
    """(chunk_id, document_id, page_number, chunk_index, text) of pages(document_id, page_number, text).

    With `continuous`, a document is one text: cut sentences are finished and the heading in force goes on to the next
    page; else each page stands alone. Null and blank pages have no chunks."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    rows = stitched(pages) if continuous else pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.last("_last", ignorenulls=True).over(before) if continuous else F.lit(None).cast("string")
    rows = rows.withColumn("_last", _last("text") if continuous else F.lit(None).cast("string")).withColumn("_heading", heading)

    @F.pandas_udf(TY.ArrayType(TY.StringType()))
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, headings in in_pieces(parts):
            yield pd.Series([page_chunks(t, h if isinstance(h, str) else None, size, overlap) for t, h in zip(texts, headings)])

    out = rows.select("document_id", "page_number", F.posexplode(cut("text", "_heading")).alias("chunk_index", "text"))
    name = F.format_string("%s_p%s_c%s", F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("chunk_index").cast("string"))
    return out.select(name.alias("chunk_id"), "document_id", "page_number", "chunk_index", "text")
