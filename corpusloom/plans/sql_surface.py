"""The guarded, read-only SQL surface over typed tables."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Words that a read-only statement may not contain outside quotes.
FORBIDDEN = (
    "insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach", "pragma", "vacuum", "reindex",
    "truncate", "grant", "revoke", "merge", "call", "set",
)
DENIED = ("randomblob", "zeroblob", "load_extension", "java_method", "reflect", "read_files")
MOST_ROWS, DEADLINE = 2000, 5.0


def bare(sql: str) -> str:
    """The statement without strings, quoted names and comments."""
    return re.sub(r"'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)


def validate(sql: str) -> str:
    """One SELECT or WITH statement without forbidden words or functions; raises ValueError otherwise."""
    text = sql.strip().rstrip(";").strip()
    flat = bare(text)
    if not re.match(r"(?i)\s*(select|with)\b", flat):
        raise ValueError("only SELECT and WITH are allowed")
    if ";" in flat:
        raise ValueError("only one statement is allowed")
    for w in (*FORBIDDEN, *DENIED):
        if re.search(rf"(?i)\b{w}\b(?!\s*\()" if w in ("replace",) else rf"(?i)\b{w}\b", flat):
            raise ValueError(f"{w} is not allowed")
    return text


def expressions(sql: str) -> set[str]:
    """Names of the common table expressions of a statement, in lower case."""
    return {x.lower() for x in re.findall(r"(?i)(?:with|,)\s+(?:recursive\s+)?(\w+)(?:\s*\([^)]*\))?\s+as\s*\(", bare(sql))}


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the relations that the parsed statement reads, without its own common table expressions."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    names = {x.strip("[] ") for x in re.findall(r"UnresolvedRelation \[([^\]]+)\]", plan)}
    return {n for n in names if n.lower() not in expressions(sql)}


def query_table(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int = 1000, deadline: float = DEADLINE) -> tuple[list[str], list[tuple], bool]:
    """(columns, rows, truncated) of a statement over the given tables; others, hidden ones included, look missing.

    One row more than the cap is read to tell whether rows are left out; a timer cancels the job group at the deadline."""
    text = validate(sql)
    known = {k.lower(): v for k, v in tables.items()}
    for name in relations(spark, text):
        if name.lower() not in known:
            raise ValueError(f"no such table: {name}")
    for name in expressions(text) - known.keys():
        if spark.catalog.tableExists(name):  # where the expression is out of scope, its name would reach that table
            raise ValueError(f"{name} is no name for a common table expression")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    cap = max(1, min(MOST_ROWS, max_rows))
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "query_table", interruptOnCancel=True)
    timer = threading.Timer(deadline, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        df = spark.sql(text).limit(cap + 1)
        rows = [tuple(r) for r in df.collect()]
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return df.columns, rows[:cap], len(rows) > cap
