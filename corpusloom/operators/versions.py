"""Versions of documents by their names and opening texts: which file replaces which, as suggestions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let, normalize_text, text_hash
from corpusloom.storage import cut

# File endings, copy marks, years, version numbers and revisions in file names, and what parts words.
ENDING, COPY = r"\.[A-Za-z0-9]{1,8}$", r"(?i)(?:[ _-]*\((\d+)\)|[ _-]*[-_ ]copy(?:[ _-]*(\d+))?)\s*$"
YEAR, VERSION = r"(?<!\d)((?:19|20)\d{2})(?!\d)", r"(?i)(?<![a-z0-9])v(?:er(?:sion)?)?[ ._-]?(\d+(?:\.\d+)*)(?![a-z0-9])"
REVISION, PARTED = r"(?i)(?<![a-z0-9])rev(?:ision)?[ ._-]?([a-z]|\d+)(?![a-z0-9])", r"[\s._\-]+"
#: An opening text must be so long to tell documents.
LEAST_TEXT = 80


def _without_first(text: Column, pattern: str) -> Column:
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_extract(text, pattern, 0))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + size, F.length(text)))).otherwise(text)


def plain_name(name: Column) -> Column:
    """A file name without its ending, words parted by single spaces, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), ENDING, ""), PARTED, " ")))


def file_versions(documents: DataFrame, numbered: Sequence[str] = ()) -> DataFrame:
    """documents with stem, year, version (numbers), rev, is_copy and cue (whether the name says any of these).

    Copy marks, then the first year, version and revision are taken out of the name, in this order; a letter counts as
    its place. Stems of under three characters say nothing. `numbered` lists words of the collection's names after which a
    document's own number stands: Policy 1999 is then the policy of that number, not one of that year."""
    dated = "".join(rf"(?<!(?i:{re.escape(w)})[\s._\-])" for w in numbered) + YEAR

    def parts(n: Column) -> Column:
        return let(F.regexp_replace(n, COPY, ""), lambda a: let(_without_first(a, dated), lambda b: let(_without_first(b, VERSION), lambda c: of(n, a, b, c))))

    def of(n: Column, a: Column, b: Column, c: Column) -> Column:
        numbers = F.transform(F.filter(F.split(F.regexp_extract(b, VERSION, 1), r"\."), lambda x: x != ""), lambda x: x.try_cast("long"))
        letter = F.lower(F.regexp_extract(c, REVISION, 1))
        rev = F.when(letter == "", F.lit(0).cast("long")).otherwise(F.coalesce(letter.try_cast("long"), (F.ascii(letter) - 96).cast("long")))
        year = F.coalesce(F.regexp_extract(a, dated, 1).try_cast("int"), F.lit(0))
        stem = F.lower(F.trim(F.regexp_replace(_without_first(c, REVISION), PARTED, " ")))
        return F.struct(stem.alias("stem"), year.alias("year"), numbers.alias("version"), rev.alias("rev"), n.rlike(COPY).alias("is_copy"))

    name = F.regexp_replace(F.trim(F.coalesce("filename", F.lit(""))), ENDING, "")
    rows = documents.withColumn("_p", let(name, parts)).select(*documents.columns, "_p.*")
    cue = (F.length("stem") >= 3) & (F.col("is_copy") | (F.col("year") > 0) | (F.size("version") > 0) | (F.col("rev") > 0))
    return rows.withColumn("cue", cue)


def suggested_replacements(documents: DataFrame, texts: DataFrame | None = None, numbered: Sequence[str] = ()) -> DataFrame:
    """(document_id, replaced_by, reason, confidence): what is likely replaced by what; nothing is applied.

    documents: document_id, filename, uploaded_at, superseded_by; texts: document_id, text (the opening one). Names of one
    stem are versions of one document, a bare name the oldest: older ones are replaced by the highest (year, version,
    revision), `version_in_name`. A copy and the latest original pair by their time, `copy_of`. Documents of the same
    opening text are replaced by the latest of them, `same_text`. Documents that are marked as replaced already are left
    alone, and of several reasons for a pair the first counts. Families are summed up by aggregates, never listed.
    `numbered`: as in file_versions."""
    known = documents.select("document_id", "filename", F.coalesce("uploaded_at", F.lit("")).alias("stamp"), F.col("superseded_by").isNotNull().alias("done"))
    parsed = cut(file_versions(known, numbered))  # names are read once
    cued = parsed.filter("cue").select("document_id", "stem", F.struct("year", "version", "rev").alias("key"), "is_copy", "stamp", "done")
    bare = parsed.select("document_id", plain_name(F.col("filename")).alias("stem"), "stamp", "done").join(cued.select("stem").distinct(), "stem", "left_semi").join(cued.select("document_id", "stem"), ["document_id", "stem"], "left_anti")
    bare = bare.groupBy("stem").agg(F.min(F.struct("document_id", "stamp", "done")).alias("b")).select("b.document_id", "stem", F.struct(F.lit(0).alias("year"), F.array().cast("array<bigint>").alias("version"), F.lit(0).cast("bigint").alias("rev")).alias("key"), F.lit(False).alias("is_copy"), "b.stamp", "b.done")
    family = cued.withColumn("key", F.struct(F.col("key.year").cast("int").alias("year"), F.col("key.version").alias("version"), F.col("key.rev").cast("bigint").alias("rev"))).unionByName(bare)
    versioned = family.filter("NOT is_copy")
    top = versioned.groupBy("stem").agg(F.max(F.struct("key", "stamp", "document_id")).alias("t"))
    by_name = versioned.join(top, "stem").filter("NOT done AND key <> t.key").select("document_id", F.col("t.document_id").alias("replaced_by"), F.lit("version_in_name").alias("reason"), F.lit("high").alias("confidence"), F.lit(1).alias("o"))
    original = versioned.groupBy("stem").agg(F.max(F.struct("stamp", "document_id", "done")).alias("g"))
    pairs = family.filter("is_copy").join(original, "stem")
    copy_is_new = (F.col("stamp") > F.col("g.stamp")) | (F.col("stamp") == F.col("g.stamp"))
    copies = pairs.select(
        F.when(copy_is_new, F.col("g.document_id")).otherwise(F.col("document_id")).alias("document_id"), F.when(copy_is_new, F.col("document_id")).otherwise(F.col("g.document_id")).alias("replaced_by"),
        F.when(copy_is_new, F.col("g.done")).otherwise(F.col("done")).alias("done"),
    ).filter("NOT done").select("document_id", "replaced_by", F.lit("copy_of").alias("reason"), F.lit("medium").alias("confidence"), F.lit(2).alias("o"))
    found = by_name.unionByName(copies)
    if texts is not None:
        norm = normalize_text(F.col("text"))
        marked = texts.select("document_id", norm.alias("n")).filter(F.length("n") >= LEAST_TEXT).select("document_id", text_hash(F.col("n")).alias("h")).join(known, "document_id")
        latest = marked.groupBy("h").agg(F.max(F.struct("stamp", "document_id")).alias("m"))
        same = marked.join(latest, "h").filter("NOT done AND document_id <> m.document_id")
        found = found.unionByName(same.select("document_id", F.col("m.document_id").alias("replaced_by"), F.lit("same_text").alias("reason"), F.lit("medium").alias("confidence"), F.lit(3).alias("o")))
    return found.filter("document_id <> replaced_by").groupBy("document_id", "replaced_by").agg(F.min_by("reason", "o").alias("reason"), F.min_by("confidence", "o").alias("confidence"))
