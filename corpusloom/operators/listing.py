"""Filters, predicates, listings and paging over documents and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = "quarantined"


def servable(status: Column) -> Column:
    """Not quarantined; a missing status is clear."""
    return F.coalesce(status, F.lit("clear")) != HIDDEN


def extension_key(name: Column) -> Column:
    """The lower-cased extension with its dot, or the whole lower-cased name."""
    low = F.lower(name)
    return F.when(F.instr(low, ".") > 0, F.concat(F.lit("."), F.element_at(F.split(low, "\\."), -1))).otherwise(low)


def filter_chunks(chunks: DataFrame, docs: DataFrame, document_ids: Sequence[int] | None = None, source_formats: Sequence[str] | None = None, filenames: Sequence[str] | None = None, date_from: str | None = None, date_to: str | None = None, source_types: Sequence[str] | None = None) -> DataFrame:
    """Chunk ids that pass every given filter; None filters nothing, an empty list passes nothing."""
    joined = chunks.join(docs.select("document_id", "filename", "source_format", "uploaded_at", "source_type"), "document_id", "left")
    tests = []
    if document_ids is not None:
        tests.append(F.col("document_id").isin(list(document_ids)))
    if source_formats is not None:
        tests.append(F.lower("source_format").isin([x.lower() for x in source_formats]))
    if filenames is not None:
        tests.append(F.col("filename").isin(list(filenames)))
    if date_from is not None:
        tests.append(F.coalesce("uploaded_at", F.lit("")) >= date_from)
    if date_to is not None:
        tests.append(F.coalesce("uploaded_at", F.lit("")) <= date_to)
    if source_types is not None:
        tests.append(F.coalesce("source_type", F.lit("upload")).isin(list(source_types)))
    for t in tests:
        joined = joined.filter(t)
    return joined.select("chunk_id")


def name_filter(docs: DataFrame, q: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Names that contain q in either case, and extension keys; an empty list of keys matches nothing."""
    if q:
        docs = docs.filter(F.contains(F.lower("filename"), F.lit(q.lower())))
    if keys is not None:
        docs = docs.filter(extension_key(F.col("filename")).isin(list(keys)))
    return docs


def servable_documents(docs: DataFrame, q: str | None = None, keys: Sequence[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    found = name_filter(docs, q, keys).filter(servable(F.col("policy_status")))
    return found if ids is None else found.join(ids, "document_id", "left_semi")


def hidden_ids(docs: DataFrame, outside: bool = False) -> DataFrame:
    """Ids of quarantined documents, and for a consumer outside the deployment of local-only ones."""
    hidden = ~servable(F.col("policy_status"))
    return docs.filter(hidden | (F.col("local_only") == 1) if outside else hidden).select("document_id")


def visible(docs: DataFrame, outside: bool = False) -> DataFrame:
    return docs.join(hidden_ids(docs, outside), "document_id", "left_anti")


SORTS = {
    "newest": lambda: [F.coalesce("uploaded_at", F.lit("")).desc()],
    "oldest": lambda: [F.coalesce("uploaded_at", F.lit("9")).asc()],
    "name": lambda: [F.lower("filename").asc()],
    "name_desc": lambda: [F.lower("filename").desc()],
    "largest": lambda: [F.coalesce("file_size", F.lit(-1)).desc()],
    "smallest": lambda: [F.coalesce("file_size", F.lit(1 << 62)).asc()],
}


def find_documents(docs: DataFrame, limit: int = 50, offset: int = 0, q: str | None = None, keys: Sequence[str] | None = None, sort: str = "newest") -> DataFrame:
    """A page of servable documents under one of six sorts; ties by document id."""
    return servable_documents(docs, q, keys).orderBy(*SORTS[sort](), "document_id").offset(offset).limit(limit)


def before(rows: DataFrame, id_col: str, last: int | None, limit: int) -> DataFrame:
    """Keyset page: the newest `limit` rows with an id below `last`."""
    return (rows if last is None else rows.filter(F.col(id_col) < last)).orderBy(F.desc(id_col)).limit(limit)


def since(rows: DataFrame, id_col: str, last: int, limit: int) -> DataFrame:
    """The newest `limit` rows after a cursor, oldest first."""
    return rows.filter(F.col(id_col) > last).orderBy(F.desc(id_col)).limit(limit).orderBy(id_col)


def find_text(chunks: DataFrame, pattern: str, literal: bool = True, case_sensitive: bool = False, limit: int = 100) -> DataFrame:
    """Chunks with a literal or a regular expression, in corpus order, with the first match's 1-based place."""
    text = F.col("text")
    if literal:
        hay, needle = (text, pattern) if case_sensitive else (F.lower(text), pattern.lower())
        at = F.instr(hay, needle)
    else:
        at = F.regexp_instr(text, F.lit(pattern if case_sensitive else f"(?i){pattern}"))
    return chunks.withColumn("at", at).filter("at > 0").orderBy("document_id", "chunk_index").limit(limit)


def excerpt(text: Column, at: Column, size: Column | int, around: int = 80) -> Column:
    """The match between guillemets with up to `around` characters at either side."""
    size = size if isinstance(size, Column) else F.lit(size)
    start = F.greatest(F.lit(1), at - around)
    return F.concat(F.substring(text, start, at - start), F.lit("«"), F.substring(text, at, size), F.lit("»"), F.substring(text, at + size, F.lit(around)))


def first_matching(chunks: DataFrame, pattern: str) -> DataFrame:
    """The first chunk of each document that matches a pattern."""
    hit = chunks.filter(F.col("text").rlike(pattern))
    return hit.groupBy("document_id").agg(F.min(F.struct("page_number", "chunk_index", "chunk_id")).alias("m")).select("document_id", "m.chunk_id")


def effective_sensitivity(own: Column, collection: Column) -> Column:
    return F.coalesce(own, collection, F.lit("internal"))


def effective_classification(own: Column, own_local: Column, inherited: Column, inherited_local: Column) -> Column:
    """The own marking, else the inherited one; an inherited local-only marking beats an own one that is a label only."""
    return F.when(inherited_local & ~F.coalesce(own_local, F.lit(False)), inherited).otherwise(F.coalesce(own, inherited))


def safe_cell(value: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(value.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def row_search(rows: DataFrame, columns: Sequence[str], terms: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Rows in which every term (or its singular, for words of over three letters) occurs in some column."""
    for t in terms:
        t = t.lower()
        forms = [t, t[:-1]] if len(t) > 3 and t.endswith("s") else [t]
        test = F.lit(False)
        for c in columns:
            for f in forms:
                test = test | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(f)), F.lit(False))
        rows = rows.filter(test)
    return rows.orderBy(*order).limit(limit)
