"""A catalogue of typed tables: profiled, coerced and written as Parquet, found again by table, file or document.

Each table has a record of its own with versions. Its data are written first, under a new name, and become the table's by
publishing the next version of the record: readers of the old version read on, new ones see the new, and a writer that
fails leaves the table as it was. So replacing is one switch, and nothing is rewritten that belongs to other tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import inference as I
from corpusloom.storage import Record, _path, cut, remove

PREFIX = "csv_data_"
_STATS = ("min", "max", "mean", "sum", "p25", "p50", "p75", "count")


def profile(rows: DataFrame, order: str | None = None, registry: I.Registry | None = None) -> DataFrame:
    """One row a column: column, type, null_count, distinct_count, first and last date, and statistics of its numbers.

    Type, distinct values and statistics look at the first 2,000 values that are no null markers, in the order of a
    column (else as rows come); nulls are counted over all rows. Boolean if all of three values at most say so, date from
    80 % on, then registered types, integer, real, text. A column of null markers is text. All columns are profiled in one
    pass: cells are ranked by column, of which each task keeps 2,000, and summed."""
    types = registry.types if registry else []
    names = [c for c in rows.columns if c != order]
    at = F.col(f"`{order}`") if order else F.monotonically_increasing_id()
    cells = rows.select(at.alias("_at"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])).alias("c")).select("_at", "c.column", "c.v")
    null = F.col("v").isNull() | F.coalesce(T.is_null_marker(F.col("v")), F.lit(True))
    nulls = cells.groupBy("column").agg(F.count_if(null).alias("null_count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("_at"))
    first = cells.filter(~null).withColumn("_k", rank).filter(F.col("_k") <= I.SAMPLE).withColumn("v", F.trim("v"))
    number = T.parse_number(F.col("v"))
    tests = {f"x{j}": t.test(F.col("v")) for j, t in enumerate(types)}
    values = {f"y{j}": F.when(t.test(F.col("v")), t.coerce(F.col("v")).try_cast("double")) for j, t in enumerate(types)}
    first = cut(first)  # 2,000 values a column at most
    flags = first.select("column", "v", T.is_bool(F.col("v")).alias("b"), T.parse_date(F.col("v")).alias("d"), number.alias("n"), *[c.alias(k) for k, c in {**tests, **values}.items()])
    flags = cut(flags)
    either = F.coalesce("n", *values)
    sums = flags.groupBy("column").agg(
        F.count("*").alias("size"), F.countDistinct("v").alias("distinct_count"), F.bool_and(F.coalesce("b", F.lit(False))).alias("bool"), F.count("d").alias("dates"), F.min("d").alias("first_date"), F.max("d").alias("last_date"),
        F.count(either).alias("numbers"), F.bool_and(F.coalesce(either == F.floor(either), F.lit(True))).alias("whole"), F.count_if(F.col("n").isNull() & either.isNotNull()).alias("formatted"),
        F.sort_array(F.collect_list(either)).alias("list"), *[F.count_if(F.col(k)).alias(k) for k in tests], *[F.sort_array(F.collect_list(k)).alias(k) for k in values],
    )
    enough = lambda c: F.col(c) >= I.SHARE * F.col("size")
    kind = F.when(F.col("bool") & (F.col("distinct_count") <= I.BOOLEANS), "boolean").when(enough("dates"), "date")
    for j, t in enumerate(types):
        kind = kind.when(enough(f"x{j}") & (F.size(f"y{j}") > 0), t.name)
    kind = kind.when(enough("numbers") & F.col("whole") & (F.col("formatted") == 0), "integer").when(enough("numbers"), "real").otherwise("text")
    typed = sums.withColumn("type", kind)
    own = F.when(F.col("type").isin("integer", "real"), F.col("list"))
    for j, t in enumerate(types):
        own = F.when(F.col("type") == t.name, F.col(f"y{j}")).otherwise(own)
    typed = typed.withColumn("list", own).withColumn("_n", F.size("list"))
    at_share = lambda p: F.get("list", F.bround(F.lit(p / 100.0) * (F.col("_n") - 1)).cast("int"))
    total = F.aggregate("list", F.lit(0.0), lambda a, x: a + x)
    some = F.col("_n") > 0
    stats = {"min": F.get("list", F.lit(0)), "max": F.get("list", F.col("_n") - 1), "mean": total / F.nullif("_n", F.lit(0)), "sum": total, "p25": at_share(25), "p50": at_share(50), "p75": at_share(75), "count": F.col("_n").cast("long")}
    dates = [F.when(F.col("type") == "date", F.col(c)).alias(c) for c in ("first_date", "last_date")]
    out = typed.select("column", "type", "distinct_count", *dates, *[F.when(some, c).alias(k) for k, c in stats.items()])
    every = nulls.join(out, "column", "left")
    return every.select("column", F.coalesce("type", F.lit("text")).alias("type"), "null_count", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "first_date", "last_date", *_STATS)


def identifier(name: str, fallback: str = "col") -> str:
    """A plain identifier of at most 60 letters, digits and underscores."""
    flat = re.sub(r"[^A-Za-z0-9_]", "_", str(name)).strip("_") or fallback
    return (f"_{flat}" if flat[0].isdigit() else flat)[:60]


def unique(names: list[str], fallback: str = "col") -> list[str]:
    """Identifiers of names, numbered where they would be the same."""
    used: set[str] = set()
    out = []
    for name in names:
        base = identifier(name, fallback)
        new, n = base, 1
        while new.lower() in used:
            n += 1
            new = f"{base}_{n}"
        used.add(new.lower())
        out.append(new)
    return out


def numbered(rows: DataFrame, order: str | None, path: str) -> DataFrame:
    """rows with __row_number from 1, in the order of a column (else as they come), by way of a folder.

    Rows are sorted by ranges and written with their place in their task; how many stand in tasks before is a sum over one
    row a task, which alone is broadcast."""
    dealt = rows.repartitionByRange(F.col(f"`{order}`")).sortWithinPartitions(F.col(f"`{order}`")) if order else rows
    dealt.withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}).write.mode("overwrite").parquet(path)
    staged = rows.sparkSession.read.parquet(path)
    tasks = staged.groupBy("_task").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tasks.select("_task", (before - F.col("_first") + 1).alias("_plus"))
    return staged.join(F.broadcast(offsets), "_task").select((F.col("_place") + F.col("_plus")).alias("__row_number"), *[F.col(f"`{c}`") for c in rows.columns])


class Tables:
    """The catalogue under a path of a shared store."""

    def __init__(self, spark: SparkSession, path: str, registry: I.Registry | None = None):
        self.spark, self.path, self.registry = spark, path, registry

    def _record(self, name: str) -> Record:
        return Record(self.spark, f"{self.path}/registry/{name}")

    def create(self, document_id: str, filename: str, rows: DataFrame, sheet: str = "", order: str | None = None, roles: dict[str, str] | None = None, types: dict[str, str] | None = None, hidden: bool = False) -> dict:
        """Write a table of string columns with inferred types, or replace the one of the same document and sheet.

        `roles` and `types` settle columns by their name instead of the inference. Columns that are neither text nor
        boolean keep their originals in a twin. `order` names a column to number rows by, which isn't stored."""
        columns = [c for c in rows.columns if c != order]
        if not columns:
            raise ValueError("a table needs columns")
        name = PREFIX + identifier(document_id, "doc") + (f"_{identifier(sheet, 'sheet')}" if sheet else "")
        found = {c: {"type": "text", "null_count": 0, "distinct_count": 0} for c in columns}  # as an empty table has it
        found |= {r["column"]: r.asDict() for r in profile(rows, order, self.registry).collect()}  # one row a column
        names = unique(columns)
        kinds = {n: (types or {}).get(c, found[c]["type"]) for c, n in zip(columns, names)}
        record, data = self._record(name), f"{name}/{uuid.uuid4().hex}"
        after = (record.versions() or [0])[-1]
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        texts = rows.select(*([F.col(f"`{order}`").alias("__order")] if order else []), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(columns, names)])
        placed = numbered(texts, "__order" if order else None, staging).drop("__order")
        typed = I.coerce(placed, {"__row_number": "number", **kinds}, self.registry, keep=("__row_number",))
        typed.write.parquet(f"{self.path}/data/{data}")
        remove(self.spark, staging)
        n = self.spark.read.parquet(f"{self.path}/data/{data}").count()
        described = [
            {"name": c, "sql_name": s, "type": kinds[s], "role": (roles or {}).get(c) or (self.registry.role(c) if self.registry else None), "raw_sql_name": f"{s}__raw" if f"{s}__raw" in typed.columns else None,
             "null_count": found[c]["null_count"], "distinct_count": found[c]["distinct_count"], "stats": {k: v for k, v in found[c].items() if k in (*_STATS, "first_date", "last_date") and v is not None}}
            for c, s in zip(columns, names)
        ]
        entry = {"document_id": document_id, "sheet_name": sheet, "filename": filename, "table_name": name, "row_count": n, "column_count": len(columns), "columns": described, "data": data, "hidden": hidden}
        record.publish(entry, after)
        return entry

    def hide(self, name: str, hidden: bool = True) -> None:
        record = self._record(name)
        entry = record.read()
        if entry is None:
            raise KeyError(name)
        record.publish({**entry, "hidden": hidden}, record.versions()[-1])

    def entries(self) -> DataFrame:
        """(table_name, document_id, sheet_name, filename, row_count, column_count, hidden, version, entry): the latest complete version of each table."""
        store, where = _path(self.spark, f"{self.path}/registry")
        kinds = "table_name string, document_id string, sheet_name string, filename string, row_count long, column_count long, hidden boolean"
        if not store.exists(where):
            return self.spark.createDataFrame([], f"{kinds}, version int, entry string")
        files = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(f"{self.path}/registry")
        place = F.col("_metadata.file_path")
        rows = files.select("value", F.regexp_extract(place, "/registry/([^/]+)/v([0-9]+)/part-", 1).alias("name"), F.regexp_extract(place, "/registry/([^/]+)/v([0-9]+)/part-", 2).try_cast("int").alias("version"))
        last = rows.filter("version IS NOT NULL AND value <> ''").groupBy("name").agg(F.max_by("value", "version").alias("entry"), F.max("version").alias("version"))
        return last.select(F.from_json("entry", kinds).alias("e"), "version", "entry").select("e.*", "version", "entry")

    def tables(self, hidden: bool = False) -> DataFrame:
        """The tables by file and sheet, without hidden ones unless they are asked for."""
        rows = self.entries() if hidden else self.entries().filter("NOT hidden")
        return rows.drop("entry").orderBy("filename", "sheet_name", "table_name")

    def schema(self, name: str, kind: str | None = None) -> dict | None:
        """The entry of a table by its name, file or document (`kind`: table_name, filename, document_id; None: any); of several the first sheet."""
        kinds = ("table_name", "filename", "document_id")
        if kind not in (None, *kinds):
            raise ValueError(f"kind must be one of {kinds}")
        test = F.lit(False)
        for c in kinds if kind is None else (kind,):
            test = test | (F.col(c) == name)
        found = self.entries().filter(test).orderBy("sheet_name", "table_name").limit(1).collect()
        return json.loads(found[0].entry) if found else None

    def suggest(self, name: str, limit: int = 3) -> list[str]:
        known = self.entries().select("table_name", "filename", "document_id").collect()
        return I.suggest(name, [x for r in known for x in r], limit)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as its record names them now, or named them at a version."""
        entry = self._record(name).read(version)
        if entry is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/data/{entry['data']}")

    def vacuum(self, name: str) -> int:
        """Delete the data of a table's earlier versions; how many folders went. Readers of these must be done."""
        entry = self._record(name).read()
        store, where = _path(self.spark, f"{self.path}/data/{name}")
        old = [s.getPath().toString() for s in store.listStatus(where) if not entry["data"].endswith(s.getPath().getName())]
        for folder in old:
            remove(self.spark, folder)
        return len(old)


def column_rows(tables: DataFrame) -> DataFrame:
    """(table_name, name, sql_name, type, role) of entries(): one row a column."""
    kind = "columns array<struct<name: string, sql_name: string, type: string, role: string, null_count: long, distinct_count: long>>"
    return tables.select("table_name", F.inline(F.from_json("entry", kind).getField("columns")))

