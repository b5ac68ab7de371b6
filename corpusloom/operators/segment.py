"""Text segmentation: chunks with overlap, sentences, cues, uncovered intervals, entities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY


#: Places to end a window at, the first kind that its last fifth has.
ENDS = (". ", "! ", "? ", "\n\n", "\n", " ")


def windows(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Windows that end after a sentence, a line or a word of their last fifth; each starts `overlap` before the last one's end.

    A text that fits is one window; a last window may hold overlap only, as the walk ends when a start is past the text."""
    if len(text) <= size:
        return [text] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            tail = text[end - int(size * 0.2) : end]
            mark = next((m for m in ENDS if m in tail), None)
            if mark:
                end += tail.rindex(mark) + len(mark) - len(tail)
        if piece := text[start:end].strip():
            out.append(piece)
        start = max(end - overlap, start + 1) if overlap < size else end
    return out


CHUNKS = TY.ArrayType(TY.StringType())
#: Rows of a batch that are worked on at a time.
PIECE = 256


def in_pieces(batches: Iterator) -> Iterator:
    """Batches of a column, or of several, in pieces of a few rows: what is made of them is handed on before the next."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), PIECE):
            piece = tuple(c.iloc[at : at + PIECE] for c in columns)
            yield piece if isinstance(batch, tuple) else piece[0]


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(chunk_id, document_id, page_number, chunk_index, text) of pages(document_id, page_number, text)."""

    @F.pandas_udf(CHUNKS)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in in_pieces(texts):
            yield pd.Series([windows(t, size, overlap) if t else [] for t in s])

    rows = docs.select("document_id", "page_number", F.posexplode(cut("text")).alias("chunk_index", "text"))
    return rows.select(F.format_string("%s_p%s_c%s", F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "page_number", "chunk_index", "text")


# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "al", "e.g", "i.e", "cf", "fig", "figs", "eq", "eqs", "vs", "p", "pp", "vol", "no", "ed", "eds",
    "ch", "sec", "dr", "mr", "mrs", "ms", "prof", "st", "approx", "ca", "etc", "inc", "ltd", "jr", "sr",
)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences end at . ! ? before space and a capital, a digit or a quote, not after abbreviations or initials."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s+[A-Z0-9\"'(]|\s*$)", text):
        word = re.search(r"([\w.]+)$", text[start : m.start()])
        if word and m[0].startswith(".") and (word[1].lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]", word[1])):
            continue
        a = start + len(text[start : m.end()]) - len(text[start : m.end()].lstrip())
        if m.end() > a:
            out.append((a, m.end()))
        start = m.end()
    rest = text[start:]
    if rest.strip():
        out.append((start + len(rest) - len(rest.lstrip()), len(text.rstrip())))
    return out


@F.pandas_udf(CHUNKS)
def sentences(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in in_pieces(texts):
        yield pd.Series([[t[a:b] for a, b in sentence_spans(t)] if t else [] for t in s])


def acronyms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\b[A-Z]{2,6}\\b"), F.lit(0)))


def phrases(text: str, most: int = 20) -> list[str]:
    """Acronyms, then runs of capitalised words; a single word that begins a sentence does not count."""
    found = dict.fromkeys(re.findall(r"\b[A-Z]{2,6}\b", text))
    for a, b in sentence_spans(text):
        body = text[a:b]
        for m in re.finditer(r"[A-Z][\w'-]*(?:\s+[A-Z][\w'-]*)*", body):
            run = m[0].split()
            if m.start() == 0 and len(run) == 1:
                continue
            found.setdefault(" ".join(run))
    out = dict.fromkeys(re.sub(r"('s|s)$", "", x.lower()) for x in found if len(x) > 1)
    return list(out)[:most]


@F.pandas_udf(CHUNKS)
def extract_entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in in_pieces(texts):
        yield pd.Series([phrases(t) if t else [] for t in s])


def content_words(text: Column) -> Column:
    from corpusloom.operators.search import STOPWORDS

    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(list(STOPWORDS)))


def display_form(terms: DataFrame) -> DataFrame:
    """(term, form, passages): the most frequent written form of each term, capitals on ties."""
    count = terms.groupBy("term", "form").agg(F.count("*").alias("n"))
    best = count.groupBy("term").agg(F.min_by("form", F.struct((-F.col("n")).alias("n"), (F.col("form") == F.lower("form")).alias("low"), "form")).alias("form"))
    return best.join(terms.groupBy("term").agg(F.countDistinct("passage").alias("passages")), "term")


def timed_cues(lines: DataFrame) -> DataFrame:
    """(document_id, start, end, text): a line's end is the next later start, else five seconds on."""
    seconds = F.split_part("stamp", F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part("stamp", F.lit(":"), F.lit(2)).cast("int")
    rows = lines.withColumn("stamp", F.regexp_extract("text", "^\\[([0-9]{2}:[0-9]{2})\\]", 1)).filter("stamp <> ''").withColumn("start", seconds)
    later = F.min("start").over(Window.partitionBy("document_id").orderBy("start").rangeBetween(1, Window.unboundedFollowing))
    return rows.select("document_id", "start", F.coalesce(later, F.col("start") + 5).alias("end"), F.trim(F.regexp_replace("text", "^\\[[0-9:]+\\]", "")).alias("text"))


def gaps(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """(document_id, start, end) of lines that no span covers: the complement of the union of intervals."""
    before = Window.partitionBy("document_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    edges = spans.select("document_id", "start", "end").unionByName(sizes.select("document_id", (F.col("lines") + 1).alias("start"), (F.col("lines") + 1).alias("end")))
    rows = edges.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    return rows.filter("start > covered + 1").select("document_id", (F.col("covered") + 1).alias("start"), (F.col("start") - 1).alias("end"))


def webvtt(cues: DataFrame) -> DataFrame:
    """(document_id, vtt): the cues of each document as WebVTT."""
    clock = lambda s: F.format_string("%02d:%02d:%02d.000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    safe = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    line = F.concat(clock(F.col("start")), F.lit(" --> "), clock(F.col("end")), F.lit("\n"), safe)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))), lambda x: x["line"])
    return cues.groupBy("document_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(ordered, "\n\n"), F.lit("\n")).alias("vtt"))


def normalize_ocr(text: Column) -> Column:
    """Lines that are mostly neither letters nor digits go; space is flattened within lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " ")))
    kept = F.filter(lines, lambda x: 2 * F.length(F.regexp_replace(x, "[^\\p{L}\\p{N}]", "")) >= F.length(F.regexp_replace(x, "\\s", "")))
    return F.trim(F.array_join(kept, "\n"))
