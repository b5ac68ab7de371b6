"""Operator 12: difference of two snapshots of a table, with rows that only changed their key recognised.

A full outer sort-merge join on the key pairs rows; what stays unpaired gets a row_number per content, earlier rows by
ascending and later rows by descending key, and a null-safe join on content and number pairs it. Contents travel as
SHA-256 digests, one a column. The numbers come from ranges of sorted rows (`ranks.ranked`), so a content that a third
of all rows share is spread over tasks, and the joins are on (content, number), so it is spread there too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.ranks import ranked


def digest(c: str | Column) -> Column:
    """SHA-256 of a value's text, null where it is null."""
    return F.unhex(F.sha2((F.col(f"`{c}`") if isinstance(c, str) else c).cast("string"), 256))


def _whole(columns: list[str]) -> Column:
    """One digest of several digests; a null is told from every value by its mark."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.lit(b"\x01"), c), F.lit(b"\x00")) for c in columns]), 256))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, old_key, op, changed, *carry): one row a pair or unpaired row of the two snapshots.

    Equal keys pair: op is `same`, or `update` with the names of the differing columns in `changed`. Then, among unpaired
    rows of equal content, the i-th smallest earlier key pairs with the i-th largest later one: `rekey`. What is left is
    `insert` or `delete`. `key` is the later key (of a delete, the earlier), `old_key` the earlier (of an insert, null);
    `carry` names further columns of the later snapshot to return, null for deletes.

    Nulls equal only nulls, in the key as well. A key that a snapshot holds several times is paired row by row, in the
    order of the content; rows left over count as unpaired. Columns beyond these are ignored, whatever their names.
    Empty snapshots give inserts or deletes only."""
    spark, parts = before.sparkSession, [f"_c{i}" for i in range(len(columns))]
    scratch = Scratch(spark, "snapshot_diff")

    def narrow(df: DataFrame, kept: tuple[str, ...], side: str) -> DataFrame:
        picked = df.select(F.col(f"`{key}`").alias("_key"), *[digest(c).alias(p) for c, p in zip(columns, parts)], *[F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(kept)])
        written = scratch.put(side, picked)
        if written.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return written.withColumn("_n", F.lit(1).cast("bigint"))
        return ranked(scratch, f"{side}_keys", written.withColumn("_group", _whole_key()), "_group", parts, "_n").drop("_group")

    def _whole_key() -> Column:
        return F.coalesce(digest("_key"), F.lit(b""))

    def sides(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(prefix + c) for c in df.columns], F.lit(True).alias(prefix))

    old, new = sides(narrow(before, (), "before"), "a"), sides(narrow(after, carry, "after"), "b")
    joined = scratch.put("joined", old.hint("merge").join(new.hint("merge"), F.col("a_key").eqNullSafe(F.col("b_key")) & (F.col("a_n") == F.col("b_n")), "full_outer"))
    extra = [f"b_x{i}" for i in range(len(carry))]
    differs = [F.when(~F.col(f"a{p}").eqNullSafe(F.col(f"b{p}")), F.lit(c)) for c, p in zip(columns, parts)]
    changed = F.concat_ws(",", *differs) if differs else F.lit("")
    pairs = joined.filter("a and b").select(
        F.col("b_key").alias("key"), F.col("a_key").alias("old_key"), F.when(changed == "", "same").otherwise("update").alias("op"), changed.alias("changed"), *extra
    )
    left = joined.filter("b is null").select(F.lit(0).alias("_side"), F.col("a_key").alias("_key"), *[F.col(f"a{p}").alias(p) for p in parts], *[F.lit(None).cast(joined.schema[x].dataType).alias(x[1:]) for x in extra])
    right = joined.filter("a is null").select(F.lit(1).alias("_side"), F.col("b_key").alias("_key"), *[F.col(f"b{p}").alias(p) for p in parts], *[F.col(x).alias(x[1:]) for x in extra])
    content = _whole(parts) if parts else F.lit(b"")
    unpaired = left.unionByName(right).withColumn("_group", F.concat(content, F.when(F.col("_side") == 0, F.lit(b"a")).otherwise(F.lit(b"b"))))
    directions = [F.when(F.col("_side") == 0, F.col("_key")).asc_nulls_first(), F.when(F.col("_side") == 1, F.col("_key")).desc_nulls_last()]
    numbered = ranked(scratch, "unpaired", unpaired, "_group", directions, "_n").drop("_group")
    scratch.drop("before", "after")
    old, new = (sides(numbered.filter(f"_side = {i}").drop("_side"), p) for i, p in ((0, "a"), (1, "b")))
    equal = [F.col(f"a{p}").eqNullSafe(F.col(f"b{p}")) for p in parts]
    matched = old.drop(*[f"a_x{i}" for i in range(len(carry))]).hint("merge").join(new.hint("merge"), reduce(lambda x, y: x & y, equal, F.col("a_n") == F.col("b_n")), "full_outer")
    rest = matched.select(
        F.when(F.col("b"), F.col("b_key")).otherwise(F.col("a_key")).alias("key"), F.col("a_key").alias("old_key"),
        F.when(F.col("a") & F.col("b"), "rekey").when(F.col("b"), "insert").otherwise("delete").alias("op"), F.lit("").alias("changed"), *extra,
    )
    found = pairs.unionByName(rest)
    return found.select("key", "old_key", "op", "changed", *[F.col(f"b_x{i}").alias(c) for i, c in enumerate(carry)])


def later(docs: DataFrame) -> DataFrame:
    """The later snapshot of documents: crc32 of the decimal doc_id modulo 10 drops a row (0), appends `+` to its text
    (1), swaps lang and source (2), changes its key to -1-key (3), does so and sets source null (4), or adds a copy
    under the key -1-key (5). A row without a doc_id stays as it is."""
    kind = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(9))
    other = -1 - F.col("doc_id")
    rows = docs.select("doc_id", "text", "lang", "source").withColumn("_kind", kind).filter("_kind <> 0")
    keys = F.when(F.col("_kind").isin(3, 4), F.array(other)).when(F.col("_kind") == 5, F.array(F.col("doc_id"), other)).otherwise(F.array("doc_id"))
    return rows.select(
        F.explode(keys).alias("doc_id"), F.when(F.col("_kind") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("_kind") == 2, F.col("lang")).when(F.col("_kind") != 4, F.col("source")).alias("source"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mark = F.lit("~")
    row = F.sha2(F.concat_ws("\n", F.coalesce("text", mark), F.coalesce("lang", mark), F.coalesce("source", mark)), 256)
    return snapshot_diff(docs, later(docs).withColumn("row_sha256", row), "doc_id", ["text", "lang", "source"], ("row_sha256",))


#: crc32 of the decimal digits of an id: eight steps a byte of the reflected polynomial.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLE = f"""WITH d AS (SELECT doc_id, text, lang, source, coalesce({CRC32.format(id="doc_id")} % 10, 9) AS k FROM documents),
a AS (SELECT doc_id AS ak, text AS atext, lang AS alang, source AS asource, row_number() OVER (PARTITION BY doc_id ORDER BY text, lang, source) AS an FROM d),
l AS (SELECT CASE WHEN k IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS bk, CASE WHEN k = 1 THEN coalesce(text, '') || '+' ELSE text END AS btext,
    CASE WHEN k = 2 THEN source ELSE lang END AS blang, CASE WHEN k = 2 THEN lang WHEN k <> 4 THEN source END AS bsource FROM d WHERE k <> 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM d WHERE k = 5),
b AS (SELECT *, row_number() OVER (PARTITION BY bk ORDER BY btext, blang, bsource) AS bn FROM l),
p AS (SELECT * FROM a JOIN b ON ak IS NOT DISTINCT FROM bk AND an = bn),
u AS (SELECT ak, atext, alang, asource, row_number() OVER (PARTITION BY atext, alang, asource ORDER BY ak NULLS FIRST) AS i FROM a ANTI JOIN b ON ak IS NOT DISTINCT FROM bk AND an = bn),
v AS (SELECT bk, btext, blang, bsource, row_number() OVER (PARTITION BY btext, blang, bsource ORDER BY bk DESC NULLS LAST) AS j FROM b ANTI JOIN a ON ak IS NOT DISTINCT FROM bk AND an = bn),
r AS (SELECT bk, ak, concat_ws(',', CASE WHEN atext IS DISTINCT FROM btext THEN 'text' END, CASE WHEN alang IS DISTINCT FROM blang THEN 'lang' END, CASE WHEN asource IS DISTINCT FROM bsource THEN 'source' END) AS changed, btext, blang, bsource, 1 AS pair, true AS late FROM p
  UNION ALL SELECT bk, ak, '', btext, blang, bsource, CASE WHEN i IS NULL THEN 3 WHEN j IS NULL THEN 4 ELSE 2 END, j IS NOT NULL
    FROM u FULL JOIN v ON atext IS NOT DISTINCT FROM btext AND alang IS NOT DISTINCT FROM blang AND asource IS NOT DISTINCT FROM bsource AND i = j)
SELECT CASE WHEN late THEN bk ELSE ak END AS key, ak AS old_key, CASE pair WHEN 1 THEN CASE WHEN changed = '' THEN 'same' ELSE 'update' END WHEN 2 THEN 'rekey' WHEN 3 THEN 'insert' ELSE 'delete' END AS op, changed,
  CASE WHEN late THEN sha256(coalesce(btext, '~') || chr(10) || coalesce(blang, '~') || chr(10) || coalesce(bsource, '~')) END AS row_sha256 FROM r"""
