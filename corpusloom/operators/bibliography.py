"""Authors, reference lists and citation exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTICLES = ("van", "von", "de", "der", "den", "da", "di", "du", "la", "le", "bin", "al")


def parse_author(raw: str) -> tuple[list[str], str]:
    """(given names, surname) of `Surname, Given` or `Given Surname`; particles belong to the surname."""
    text = re.sub(r"\s+", " ", raw or "").strip(" ,;")
    if "," in text:
        last, _, first = text.partition(",")
        return first.split(), last.strip()
    parts = text.split()
    k = len(parts) - 1
    while k > 1 and parts[k - 1].lower() in PARTICLES:
        k -= 1
    return parts[: max(k, 0)], " ".join(parts[max(k, 0) :])


def initials(given: list[str]) -> str:
    return " ".join(f"{g[0].upper()}." for g in given if g)


def _join(names: list[str], last: str) -> str:
    return names[0] if len(names) == 1 else ", ".join(names[:-1]) + last + names[-1] if names else ""


def reference(item: dict, style: str = "apa") -> str:
    """One entry in APA, Chicago, MLA, IEEE or Harvard form from authors, year, title, venue and doi."""
    people = [parse_author(a) for a in item.get("authors") or []]
    year, title, venue, doi = item.get("year") or "n.d.", item.get("title") or "Untitled", item.get("venue"), item.get("doi")
    inverted = [f"{s}, {initials(g)}".rstrip(", ") for g, s in people]
    tail = f" {venue}." if venue else ""
    link = f" https://doi.org/{doi}" if doi else ""
    if style == "ieee":
        return f"{_join([f'{initials(g)} {s}'.strip() for g, s in people], ' and ')}, “{title},”{f' {venue},' if venue else ''} {year}.{link}".lstrip(", ")
    if style == "mla":
        lead = f"{people[0][1]}, {' '.join(people[0][0])}".rstrip(", ") + (", et al" if len(people) > 2 else f", and {' '.join([*people[1][0], people[1][1]])}" if len(people) == 2 else "") if people else ""
        return f"{lead}. “{title}.”{f' {venue},' if venue else ''} {year}.{link}".lstrip(". ")
    if style == "chicago":
        return f"{_join(inverted, ', and ')} {year}. “{title}.”{tail}{link}".lstrip()
    if style == "harvard":
        return f"{_join(inverted, ' and ')} ({year}) ‘{title}’,{tail}{link}".lstrip()
    return f"{_join(inverted, ', & ')} ({year}). {title}.{tail}{link}".lstrip()


def export(item: dict, form: str, key: str) -> str:
    """BibTeX or RIS of one item."""
    pairs = [("title", item.get("title")), ("year", item.get("year")), ("journal", item.get("venue")), ("doi", item.get("doi"))]
    if form == "ris":
        tags = {"title": "TI", "year": "PY", "journal": "JO", "doi": "DO"}
        return "\n".join(["TY  - JOUR", *[f"AU  - {a}" for a in item.get("authors") or []], *[f"{tags[k]}  - {v}" for k, v in pairs if v], "ER  - "])
    body = [f"  author = {{{' and '.join(item.get('authors') or [])}}}", *[f"  {k} = {{{v}}}" for k, v in pairs if v]]
    return f"@article{{{key},\n" + ",\n".join(body) + "\n}"


def suggest_filename(year: Column, authors: Column, title: Column) -> Column:
    """`2024 - Surname et al - Title`, without characters that file systems refuse."""
    last = F.element_at(F.split(F.get(authors, F.lit(0)), " "), -1)
    who = F.when(F.size(authors) > 2, F.concat(last, F.lit(" et al"))).otherwise(last)
    return F.substring(F.regexp_replace(F.concat_ws(" - ", year.cast("string"), who, title), '[\\\\/:*?"<>|]', ""), 1, 120)


def entries(pages: DataFrame) -> DataFrame:
    """(document_id, k, entry) of numbered reference lists: the lines after a heading `References`, one entry a number."""
    tail = F.regexp_extract("text", "(?is)\\n\\s*(?:references|bibliography)\\s*\\n(.*)$", 1)
    parts = F.filter(F.split(tail, "(?m)^\\s*(?:\\[[0-9]+\\]|[0-9]+\\.)\\s+"), lambda e: F.trim(e) != "")
    return pages.select("document_id", F.posexplode(F.transform(parts, lambda e: F.trim(F.regexp_replace(e, "\\s+", " ")))).alias("k", "entry"))
