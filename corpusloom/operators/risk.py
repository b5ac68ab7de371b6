"""Fault trees: event values, cut-set quantification, importance, minimal cut sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_values(events: DataFrame) -> DataFrame:
    """(event, p): basic events by their probability or 1 - exp(-rate * time), house events 1 or 0, unknown ones null."""
    rate = 1 - F.exp(-F.col("failure_rate") * F.coalesce("mission_time", F.lit(8760.0)))
    p = F.when(F.col("kind") == "house", F.col("probability")).otherwise(F.coalesce("probability", F.when(F.col("failure_rate").isNotNull(), rate)))
    return events.select(F.col("name").alias("event"), p.alias("p"))


def literals(cut_sets: DataFrame, events: DataFrame) -> DataFrame:
    """(context, rank, literal, event, value) of distinct literals; `/X` is the complement of X."""
    rows = cut_sets.select("context", "rank", F.explode(F.array_distinct(F.transform(F.split("events", "\\*"), lambda e: F.trim(e)))).alias("literal"))
    rows = rows.withColumn("event", F.regexp_replace("literal", "^/", ""))
    value = F.when(F.col("literal").startswith("/"), 1 - F.col("p")).otherwise(F.col("p"))
    return rows.join(event_values(events), "event", "left").select("context", "rank", "literal", "event", value.alias("value"))


def product(value: str) -> Column:
    """A product that is null when any factor is; not by logarithms, since factors may be 0."""
    return F.when(F.count("*") == F.count(value), F.aggregate(F.array_sort(F.collect_list(value)), F.lit(1.0), lambda a, x: a * x))


def quantify(cut_sets: DataFrame, events: DataFrame) -> DataFrame:
    """(context, rank, probability) over the distinct events of each cut set."""
    return literals(cut_sets, events).groupBy("context", "rank").agg(product("value").alias("probability"))


def totals(quantified: DataFrame) -> DataFrame:
    """(context, rare_event, mcub, missing): the sum, and 1 - prod(1 - p) in log space (null above 1, 1 at certainty)."""
    p = F.col("probability")
    return quantified.groupBy("context").agg(
        F.sum(p).alias("rare_event"),
        F.when(F.max(p) > 1, None).when(F.max(p) == 1, 1.0).otherwise(-F.expm1(F.sum(F.when(p < 1, F.log1p(-p))))).alias("mcub"),
        F.count_if(p.isNull()).alias("missing"),
    )


def ranked_cut_sets(cut_sets: DataFrame, events: DataFrame, limit: int = 100) -> DataFrame:
    """Cut sets of each context by probability with their share of the rare-event total."""
    from pyspark.sql import Window

    q = quantify(cut_sets, events)
    q = q.join(totals(q).select("context", "rare_event"), "context")
    place = F.row_number().over(Window.partitionBy("context").orderBy(F.desc_nulls_last("probability"), "rank"))
    return q.withColumn("place", place.cast("long")).filter(F.col("place") <= limit).select("context", "rank", "place", "probability", (F.col("probability") / F.col("rare_event")).alias("share"))


def importance(cut_sets: DataFrame, events: DataFrame) -> DataFrame:
    """Per context and event on the rare-event basis: Fussell-Vesely, risk achievement and reduction worth, Birnbaum.

    The total is linear in each event, so its parts with the event at 0 and at 1 come from one grouped sum."""
    lit = literals(cut_sets, events)
    q = lit.groupBy("context", "rank").agg(product("value").alias("p"))
    total = q.groupBy("context").agg(F.sum("p").alias("total"))
    pairs = lit.join(q, ["context", "rank"])
    rest = lit.alias("l").join(lit.alias("r"), (F.col("l.context") == F.col("r.context")) & (F.col("l.rank") == F.col("r.rank")) & (F.col("l.event") != F.col("r.event")), "left")
    others = rest.groupBy(F.col("l.context").alias("context"), F.col("l.rank").alias("rank"), F.col("l.event").alias("event"), F.col("l.literal").alias("literal")).agg(
        F.aggregate(F.array_sort(F.collect_list(F.col("r.value"))), F.lit(1.0), lambda a, x: a * x).alias("rest")
    )
    rows = pairs.select("context", "rank", "event", "literal", "p").join(others, ["context", "rank", "event", "literal"])
    neg = F.col("literal").startswith("/")
    g = rows.groupBy("context", "event").agg(
        F.sum("p").alias("with_it"), F.sum(F.when(neg, 0.0).otherwise(F.col("rest"))).alias("at_1"), F.sum(F.when(neg, F.col("rest")).otherwise(0.0)).alias("at_0"), F.count("*").alias("cut_sets")
    )
    g = g.join(total, "context")
    base = F.col("total") - F.col("with_it")
    up, down = base + F.col("at_1"), base + F.col("at_0")
    return g.select("context", "event", "cut_sets", ((F.col("total") - down) / F.col("total")).alias("fv"), (up / F.col("total")).alias("raw"), F.when(down > 0, F.col("total") / down).alias("rrw"), (up - down).alias("birnbaum"))


def minimise(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    """Sets that contain no other one."""
    kept: list[frozenset[str]] = []
    by: dict[str, list[frozenset[str]]] = {}
    for s in sorted(set(sets), key=lambda s: (len(s), sorted(s))):
        if frozenset() in kept or any(k <= s for e in s for k in by.get(e, ())):
            continue
        kept.append(s)
        for e in s:
            by.setdefault(e, []).append(s)
    return kept


def cut_sets_of(gates: dict[str, tuple[str, int, list[str]]], p: dict[str, float], top: str, cutoff: float = 1e-15, max_order: int = 12, most: int = 100_000) -> list[frozenset[str]]:
    """Minimal cut sets of one tree, top down, with gates worked on from a stack; over `most` of them is an error.

    gates: name -> (and | or | atleast, k, inputs); an input may start with / for a complement."""
    from itertools import combinations

    done: list[frozenset[str]] = []
    stack: list[tuple[frozenset[str], tuple[str, ...]]] = [(frozenset(), (top,))]
    seen = set()
    while stack and len(done) < most:
        events, todo = stack.pop()
        if (events, todo) in seen:
            continue
        seen.add((events, todo))
        gate = next((t for t in todo if t.lstrip("/") in gates), None)
        plain = events | {t for t in todo if t.lstrip("/") not in gates}
        if any(f"/{e}" in plain for e in plain) or len(plain) > max_order:
            continue
        value = 1.0
        for e in plain:
            q = p.get(e.lstrip("/"), 1.0)
            value *= 1 - q if e.startswith("/") else q
        if value < cutoff:
            continue
        if gate is None:
            done.append(frozenset(plain))
            continue
        rest = tuple(t for t in todo if t != gate and t.lstrip("/") in gates)
        kind, k, inputs = gates[gate.lstrip("/")]
        if gate.startswith("/"):  # De Morgan
            inputs = [i[1:] if i.startswith("/") else f"/{i}" for i in inputs]
            kind, k = {"and": ("or", 1), "or": ("and", 0)}.get(kind, ("atleast", len(inputs) - k + 1))
        options = [tuple(inputs)] if kind == "and" else [(i,) for i in inputs] if kind == "or" else list(combinations(inputs, k))
        stack += [(plain, tuple(dict.fromkeys(rest + o))) for o in options]
    if stack:
        raise ValueError(f"{top} has over {most} cut sets; raise the cutoff or the limit")
    return minimise(done)


def generate_cut_sets(gates: DataFrame, events: DataFrame, tops: DataFrame, **limits) -> DataFrame:
    """(top, rank, events): minimal cut sets of each top gate; trees are independent, so each is a task's work."""
    import pandas as pd

    tree = {r.name: (r.type, r.k or 0, r.inputs.split()) for r in gates.collect()}
    p = {r.event: r.p for r in event_values(events).collect() if r.p is not None}

    def work(batches):
        for pdf in batches:
            out = [(top, k, " * ".join(sorted(s))) for top in pdf["top"] for k, s in enumerate(sorted(cut_sets_of(tree, p, top, **limits), key=lambda s: (len(s), sorted(s))), 1)]
            yield pd.DataFrame(out, columns=["top", "rank", "events"])

    return tops.mapInPandas(work, "top string, rank long, events string")


def tree_levels(gates: DataFrame, top: str, depth: int = 20) -> DataFrame:
    """(name, depth) of what a gate reaches, level by level, each name at its least depth."""
    edges = gates.select("name", F.explode(F.split("inputs", " ")).alias("input")).withColumn("input", F.regexp_replace("input", "^/", ""))
    seen = level = gates.sparkSession.createDataFrame([(top, 0)], "name string, depth int")
    for k in range(1, depth + 1):
        level = level.join(edges, "name").select(F.col("input").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("depth", F.lit(k))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def sort_importance(rows: DataFrame, by: str = "fv") -> DataFrame:
    """Largest first, unbounded reduction worth before all, unknown last."""
    first = F.when(F.col(by).isNull() & (F.col("cut_sets") > 0) & F.lit(by == "rrw"), 0).otherwise(1)
    return rows.orderBy("context", first, F.desc_nulls_last(by), "event")
