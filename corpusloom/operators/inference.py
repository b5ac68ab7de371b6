"""Typed tables: inferring the types of string columns, coercion with raw twins, and a type registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SAMPLE, SHARE, BOOLEANS = 2000, 0.8, 3


@dataclass
class TypeExtension:
    """A column type of one's own: a test of a value, its coercion, and the Spark type."""

    name: str
    test: Callable[[Column], Column]
    coerce: Callable[[Column], Column]
    data_type: str


@dataclass
class Registry:
    """Types and roles beside the built-in ones, in order of registration."""

    types: list[TypeExtension] = field(default_factory=list)
    roles: list[Callable[[str], str | None]] = field(default_factory=list)

    def role(self, name: str) -> str | None:
        return next((r for f in self.roles if (r := f(name))), None)


def currency() -> TypeExtension:
    form = "^[(-]?[$€£][0-9,]*\\.?[0-9]+\\)?$"
    return TypeExtension("currency", lambda v: F.trim(v).rlike(form), lambda v: T.parse_number(F.regexp_replace(v, "[$€£]", "")), "double")


def percent() -> TypeExtension:
    return TypeExtension("percent", lambda v: F.trim(v).rlike("^-?[0-9.]+\\s*%$"), lambda v: T.parse_number(F.regexp_replace(v, "%", "")) / 100, "double")


def infer(rows: DataFrame, registry: Registry | None = None) -> dict[str, str]:
    """Column -> type, for a table of strings: boolean, date, registered types, integer, real, text in that order.

    One pass over all columns (sources.tables.profile); one row a column comes to the driver."""
    from corpusloom.sources.tables import profile

    found = {r["column"]: r["type"] for r in profile(rows, registry=registry).select("column", "type").collect()}
    return {c: found.get(c, "text") for c in rows.columns}


def coerce(rows: DataFrame, types: dict[str, str], registry: Registry | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns; one that is not text keeps its trimmed original in <name>__raw. Columns to `keep` stay as they are."""
    own = {t.name: t for t in registry.types} if registry else {}
    out = []
    for c, kind in types.items():
        v = F.col(c)
        if c in keep:
            out.append(v)
            continue
        if kind in own:
            out.append(own[kind].coerce(v).cast(own[kind].data_type).alias(c))
        else:
            out.append({"boolean": T.to_bool(v), "date": T.parse_date(v), "integer": T.parse_number(v).cast("long"), "real": T.parse_number(v)}.get(kind, T.raw_value(v)).alias(c))
        if kind not in ("text", "boolean"):
            out.append(T.raw_value(v).alias(f"{c}__raw"))
    return rows.select(*out)


def suggest(name: str, known: list[str], limit: int = 3) -> list[str]:
    """Known identifiers that contain the name or are contained in it, letters and digits only."""
    import re

    flat = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    q = flat(name)
    return [k for k in known if q and (q in flat(k) or flat(k) in q)][:limit]
