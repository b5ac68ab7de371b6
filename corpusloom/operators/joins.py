"""Joins of the data model. Sides are joined by key and left to Catalyst; none is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.operators.listing import servable

#: Words of a title that are looked up by a key.
LEAD = 4


def servable_chunk_refs(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of servable documents, in a stable order."""
    open_docs = docs.filter(servable(F.col("policy_status"))).select("document_id", "filename")
    return chunks.join(open_docs, "document_id").select("chunk_id", "document_id", "filename").orderBy("chunk_id")


def supersede_info(docs: DataFrame) -> DataFrame:
    """Documents with a servable replacement, and its name."""
    target = docs.filter(servable(F.col("policy_status"))).select(F.col("document_id").alias("superseded_by"), F.col("filename").alias("replaced_by_name"))
    return docs.join(target, "superseded_by").select("document_id", "superseded_by", "replaced_by_name")


def with_replacement(docs: DataFrame) -> DataFrame:
    """All documents; a dangling or hidden replacement is null."""
    target = docs.filter(servable(F.col("policy_status"))).select(F.col("document_id").alias("_to"), F.col("filename").alias("replaced_by_name"))
    joined = docs.join(target, F.col("superseded_by") == F.col("_to"), "left")
    return joined.withColumn("superseded_by", F.when(F.col("_to").isNotNull(), F.col("superseded_by"))).drop("_to")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other side lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def entities_by_document(entities: DataFrame, chunks: DataFrame, stop: Column | None = None) -> DataFrame:
    """Distinct entities of each document, sorted; `stop` keeps only places (page_number, chunk_index) before it."""
    placed = chunks if stop is None else chunks.filter(F.struct("page_number", "chunk_index") < stop)
    return entities.join(placed, "chunk_id").groupBy("document_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def chunks_by_entities(entities: DataFrame, wanted: list[str], min_shared: int = 1, limit: int = 25) -> DataFrame:
    """Chunks that share at least min_shared of the wanted entities, most first."""
    hit = entities.filter(F.col("entity").isin(wanted)).groupBy("chunk_id").agg(F.countDistinct("entity").alias("shared"))
    return hit.filter(F.col("shared") >= min_shared).orderBy(F.desc("shared"), "chunk_id").limit(limit)


def match_references(references: DataFrame, library: DataFrame, min_title: int = 20) -> DataFrame:
    """Reference -> library paper: by DOI, else arXiv id, else the longest title that its raw text contains.

    references(ref_id, doi, arxiv_id, raw), library(paper_id, doi, arxiv_id, title_key). Only references without a paper
    yet are read for titles. Equal titles count once, under their first paper. A title is sought by the hash of its first
    LEAD words at most, as an equi-join with the runs of words of a text; what meets is tested on the text, which is
    shuffled once and not with each run."""
    by = lambda key, rank: references.join(library.select("paper_id", key), key).select("ref_id", "paper_id", F.lit(rank).alias("rank"), F.lit(0).alias("size"))
    known = by("doi", 1).unionByName(by("arxiv_id", 2))
    known = known.groupBy("ref_id").agg(F.min(F.struct("rank", F.col("size"), "paper_id")).alias("m"))
    rest = references.select("ref_id", "raw").join(known.select("ref_id"), "ref_id", "left_anti")
    words = F.split("title_key", " ")
    n = F.least(F.size(words), F.lit(LEAD))
    titled = library.filter(F.length("title_key") >= min_title).groupBy("title_key").agg(F.min("paper_id").alias("paper_id"))
    titled = titled.select("title_key", "paper_id", n.alias("n"), F.xxhash64(F.slice(words, F.lit(1), n)).alias("lead"))
    sizes = [r[0] for r in titled.select("n").distinct().collect()]
    runs = lambda w, k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))
    leads = let(F.split("raw", " "), lambda w: F.array_distinct(F.flatten(F.array(*[runs(w, k) for k in sizes])))) if sizes else F.array().cast("array<bigint>")
    met = rest.select("ref_id", F.explode(leads).alias("lead")).join(titled, "lead").select(F.col("ref_id").alias("_ref"), "paper_id", "title_key")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    contained = (
        met.join(rest, F.col("_ref").eqNullSafe(F.col("ref_id"))).filter(F.contains(padded("raw"), padded("title_key")))
        .groupBy("ref_id").agg(F.min(F.struct(F.lit(3).alias("rank"), (-F.length("title_key")).alias("size"), "paper_id")).alias("m"))
    )
    return known.unionByName(contained).select("ref_id", "m.paper_id", "m.rank")


def contact_candidates(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """People all of whose co-authors in `wanted` match, split into exact and other years."""
    joined = people.join(wanted, "surname")
    return joined.withColumn("exact_year", F.col("year") == F.col("wanted_year"))
