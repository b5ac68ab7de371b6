"""Fault and event trees from the text exports of a risk model: one project over files of several kinds, as tables.

Files are read as lines with their place; sections, blocks and continued lines are found by window functions over a file's
lines, and files are put together by joins: gates with the first definition of a name, events with their data and
descriptions, sequences with their path, end state and logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of gates by their codes, columns of the event file, and uncertainty codes with their parameter.
GATES = {"AND": "and", "OR": "or", "NAND": "nand", "NOR": "nor", "XOR": "xor", "NOT": "not", "TRAN": "transfer", "TRANSFER": "transfer"}
EVENT_COLUMNS = "name fdt udc udt udvalue prob lambda tau mission init pf udvalue2 calcprob freq analysistype phasetype project".split()
KINDS = ("FTL", "BEI", "ETL", "SQL", "SQC", "FTC", "ESC", "BED", "GTD", "FTD", "ETD", "ESD")
HEADER = r"^\s*([^\s,=]+)\s*((?:,[^,=]*)*)=\s*$"
FIELD = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, kind, at, line) of the files of known kinds; comment lines are left out."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    kind = F.upper(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1))
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    rows = files.select("file", kind.alias("kind"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.filter(F.col("kind").isin(list(KINDS)) & ~F.trim("line").startswith("*"))


def sections(rows: DataFrame) -> DataFrame:
    """Lines with the number of their section, which ^EOS ends, and its header's fields; header lines themselves go.

    A header runs from a section's first line to the one that ends in `=`."""
    order = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("_eos", F.upper(F.trim("line")).startswith("^EOS"))
    rows = rows.withColumn("section", F.coalesce(F.sum(F.col("_eos").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("NOT _eos AND trim(line) <> ''")
    own = Window.partitionBy("file", "section")
    rows = rows.withColumn("_end", F.min(F.when(F.rtrim("line").endswith("="), F.col("at"))).over(own))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= F.col("_end"), F.struct("at", "line"))).over(own)), lambda x: F.trim(x["line"])), ",")
    fields = F.filter(F.transform(F.split(F.regexp_replace(head, r"=\s*$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.filter("_end IS NOT NULL").withColumn("header", fields).filter("at > _end").select("file", "kind", "section", "header", "at", "line")


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def fields_of(line: Column) -> Column:
    """Comma-separated fields; quotes keep commas if they are balanced, and go."""
    return F.transform(F.split(line, FIELD), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, '"', " "), r"\s+", " ")))


def gates(rows: DataFrame) -> DataFrame:
    """(name, type, k, tree, inputs): every gate once, by its first definition; k of n gates are `atleast`.

    Indented lines go on with the inputs of the gate above. Gates of unknown codes are `other`; a transfer that no tree
    defines stays as `transfer`."""
    body = sections(rows.filter("kind = 'FTL'")).withColumn("t", tokens(F.col("line"))).withColumn("tree", F.get("header", F.lit(1)))
    code = F.upper(F.get("t", F.lit(1)))
    known = (F.size("t") >= 2) & (code.isin(list(GATES)) | code.rlike("^[0-9]+/[0-9]+$"))
    starts = known | ((F.size("t") >= 2) & ~F.col("line").rlike(r"^\s"))
    order = Window.partitionBy("file", "section").orderBy("at")
    body = body.withColumn("gate_at", F.last(F.when(starts, F.col("at")), ignorenulls=True).over(order)).filter("gate_at IS NOT NULL")
    parts = body.withColumn("own", F.when(F.col("at") == F.col("gate_at"), F.slice("t", 3, 1_000_000)).otherwise(F.col("t")))
    whole = parts.groupBy("file", "section", "tree", "gate_at").agg(
        F.max(F.when(F.col("at") == F.col("gate_at"), F.get("t", F.lit(0)))).alias("name"), F.max(F.when(F.col("at") == F.col("gate_at"), code)).alias("code"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])).alias("inputs"),
    )
    kind = F.when(F.col("code").rlike("^[0-9]+/[0-9]+$"), "atleast")
    for c, k in GATES.items():
        kind = kind.when(F.col("code") == c, k)
    typed = whole.select("file", "gate_at", "name", kind.otherwise("other").alias("type"), F.regexp_extract("code", "^([0-9]+)/", 1).try_cast("long").alias("k"), "tree", "inputs")
    first = F.struct((F.col("type") == "transfer").alias("a"), F.col("file").alias("b"), F.col("gate_at").alias("c"))
    one = typed.groupBy("name").agg(F.min_by(F.struct("type", "k", "tree", "inputs"), first).alias("g")).select("name", "g.*")
    return one.withColumn("inputs", F.when(F.col("type") == "transfer", F.array("name")).otherwise(F.col("inputs")))


def tops(all_gates: DataFrame) -> DataFrame:
    """(tree, top): the gate of a tree's own name, unless the tree uses it, else the first of its gates that none uses."""
    used = all_gates.select("tree", F.explode("inputs").alias("i")).select("tree", F.regexp_replace("i", "^/", "").alias("name")).distinct()
    free = all_gates.filter("type <> 'transfer'").join(used, ["tree", "name"], "left_anti")
    return free.groupBy("tree").agg(F.min(F.struct((F.col("name") != F.col("tree")).alias("other"), "name")).alias("m")).select("tree", F.col("m.name").alias("top"))


def descriptions(rows: DataFrame, kind: str) -> DataFrame:
    """(name, description) of a file of descriptions."""
    body = rows.filter(F.col("kind") == kind).filter(~F.col("line").rlike(HEADER) & ~F.upper(F.trim("line")).startswith("^EOS") & ~F.trim("line").startswith("|"))
    f = body.withColumn("f", fields_of(F.col("line"))).filter("size(f) >= 2 AND f[0] <> ''")
    return f.groupBy(F.col("f")[0].alias("name")).agg(F.max_by(F.col("f")[1], "at").alias("description"))


def events(rows: DataFrame, all_gates: DataFrame) -> DataFrame:
    """(name, kind, description, probability, failure_rate, mission_time, calc_type, uncertainty).

    The calculated probability counts before the point value; codes T and F make house events, I initiating ones. Events
    that the logic uses and no file has data of are basic events without numbers."""
    number = lambda c: F.col(c).try_cast("double")
    body = rows.filter("kind = 'BEI'").filter(~F.col("line").rlike(HEADER) & ~F.upper(F.trim("line")).startswith("^EOS"))
    f = body.withColumn("f", F.transform(F.split("line", ","), lambda x: F.trim(x))).filter(F.col("f")[0].rlike(r"^(<[^>]*>|[A-Za-z0-9][^\s,]*)$"))
    cols = f.select("at", *[F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(EVENT_COLUMNS)])
    code = F.upper("fdt")
    kind = F.when(code.isin("T", "F"), "house").when(F.upper("init") == "I", "initiating").otherwise("basic")
    p = F.when(code == "T", 1.0).when(code == "F", 0.0).otherwise(F.coalesce(number("calcprob"), number("prob")))
    ef = F.when(number("udvalue") > 1, number("udvalue")).when(number("udvalue2") > 1, number("udvalue2"))
    spread = F.when(F.upper("udt") == "L", F.concat_ws(" ", F.lit("lognormal"), F.concat(F.lit("EF="), ef.cast("string")))).when(F.col("udt").isNotNull(), F.upper("udt"))
    data = cols.groupBy("name").agg(F.max_by(F.struct(kind.alias("kind"), p.alias("probability"), F.nullif(number("lambda"), F.lit(0.0)).alias("failure_rate"), F.nullif(number("mission"), F.lit(0.0)).alias("mission_time"), F.col("fdt").alias("calc_type"), spread.alias("uncertainty")), "at").alias("e")).select("name", "e.*")
    used = all_gates.filter("type <> 'transfer'").select(F.explode("inputs").alias("i")).select(F.regexp_replace("i", "^/", "").alias("name")).distinct()
    stubs = used.join(all_gates.select("name"), "name", "left_anti").join(data.select("name"), "name", "left_anti").select("name", F.lit("basic").alias("kind"))
    every = data.unionByName(stubs, allowMissingColumns=True)
    return every.join(descriptions(rows, "BED"), "name", "left").select("name", "kind", "description", "probability", "failure_rate", "mission_time", "calc_type", "uncertainty")


def event_trees(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tree, initiating_event, place, top), (event_tree, name, end_state, transfer, path, logic, frequency, description)).

    A row of ^LOGIC starts where it branches off the row above and has the states of before from it: + is success, - is
    failure, a bare number passes a top by. Its path meets the row of ^SEQUENCES of the same place, and the logic of the
    sequence file by tree and name."""
    body = sections(rows.filter("kind = 'ETL'"))
    order = Window.partitionBy("file", "section").orderBy("at")
    label = F.when(F.trim("line").startswith("^"), F.upper(F.regexp_extract("line", r"\^([A-Za-z0-9.]*)", 1)))
    body = body.withColumns({"tree": F.get("header", F.lit(1)), "initiating_event": F.get("header", F.lit(2)), "block": F.last(label, ignorenulls=True).over(order)}).filter(~F.trim("line").startswith("^"))
    joined = body.filter("block = 'TOPS'").groupBy("tree", "initiating_event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), ",").alias("l"))
    listed = joined.select("tree", "initiating_event", F.posexplode(F.filter(F.transform(F.split("l", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("p", "top")).select("tree", "initiating_event", (F.col("p") + 1).alias("place"), "top")
    text = F.split_part("line", F.lit("//"), F.lit(1))
    token = lambda k: F.regexp_extract_all(text, F.lit(r"([+-]?)(\d+)\.\d+"), F.lit(k))
    logic = body.filter("block = 'LOGIC'").select("tree", "at", F.arrays_zip(token(1).alias("sign"), token(2).alias("number")).alias("t")).filter("size(t) > 0")
    per_tree = Window.partitionBy("tree").orderBy("at")
    logic = logic.withColumn("row", F.row_number().over(per_tree)).withColumn("columns", F.first("t").over(per_tree))
    # every top from a row's first one on has a state there, if only that it is passed by; tops before have none of their own
    cells = logic.select("tree", "row", "t", F.posexplode("columns").alias("column", "c")).select("tree", "row", "column", F.col("c.number").alias("number"), "t")
    mine = F.get(F.filter("t", lambda x: x["number"] == F.col("number")), F.lit(0))
    first = F.min(F.when(mine.isNotNull(), F.col("column"))).over(Window.partitionBy("tree", "row"))
    cells = cells.withColumn("m", mine).withColumn("own", F.when(F.col("column") >= first, F.coalesce(F.col("m.sign"), F.lit(""))))
    down = Window.partitionBy("tree", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    states = cells.withColumn("sign", F.last("own", ignorenulls=True).over(down)).select("tree", "row", "column", F.col("number").cast("int").alias("place"), "sign")
    named = states.filter("sign <> ''").join(listed.select("tree", "place", "top"), ["tree", "place"])
    state = F.when(F.col("sign") == "+", "success").otherwise("failure")
    paths = named.groupBy("tree", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "top", state.alias("state")))), lambda x: F.struct(x["top"].alias("top"), x["state"].alias("state"))).alias("path"))
    meta = body.filter("block = 'SEQUENCES'").filter(~F.upper("line").contains("SEQUENCE NAME")).withColumn("row", F.row_number().over(per_tree)).withColumn("f", fields_of(F.col("line")))
    at = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit(""))
    moves = F.coalesce(F.upper(at(8)).isin("T", "Y"), F.lit(False))
    meta = meta.select("tree", "row", F.when(~moves, at(3)).alias("end_state"), F.when(moves, at(3)).alias("transfer"), at(5).try_cast("double").alias("frequency"), F.nullif(F.concat_ws(" - ", at(1), at(7)), F.lit("")).alias("description"))
    numbers = logic.select("tree", "row").unionByName(meta.select("tree", "row")).distinct()
    width = F.greatest(F.lit(2), F.length(F.max("row").over(Window.partitionBy("tree")).cast("string")))
    numbers = numbers.withColumn("name", F.lpad(F.col("row").cast("string"), width, F.lit("0")))
    body = sections(rows.filter("kind = 'SQL'")).filter("size(header) >= 3")
    terms = body.groupBy(F.col("header")[1].alias("tree"), F.col("header")[2].alias("name")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", tokens(F.col("line")).alias("t")))), lambda x: x["t"])).alias("t"))
    terms = terms.select("tree", "name", F.filter(F.transform("t", lambda x: F.regexp_replace(x, r"\.$", "")), lambda x: x != "").alias("logic"))
    found = numbers.join(paths, ["tree", "row"], "left").join(meta, ["tree", "row"], "left").join(terms, ["tree", "name"], "full")
    return listed, found.select(F.col("tree").alias("event_tree"), "name", "end_state", "transfer", "path", "logic", "frequency", "description")


def cut_sets(rows: DataFrame) -> DataFrame:
    """(context, kind, event_tree, rank, events, order) of the files of cut sets: `*` joins events, `+` parts products."""
    body = sections(rows.filter("kind IN ('SQC', 'FTC', 'ESC')"))
    text = body.groupBy("file", "kind", "section", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ").alias("text"))
    products = F.posexplode(F.split(F.regexp_replace(F.trim("text"), r"\s*\.\s*$", ""), r"\s*\+\s*"))
    out = text.select("kind", "header", products.alias("p", "product"))
    own = F.filter(F.split("product", r"[\s*]+"), lambda e: (e != "") & (e != "<TRUE>"))
    sequence = F.col("kind") == "SQC"
    named = F.when(F.col("kind") == "SQC", "sequence").when(F.col("kind") == "FTC", "fault_tree").otherwise("end_state")
    context = F.when(sequence, F.get("header", F.lit(2))).otherwise(F.get("header", F.lit(1)))
    return out.select(context.alias("context"), named.alias("kind"), F.when(sequence, F.get("header", F.lit(1))).alias("event_tree"), (F.col("p") + 1).cast("long").alias("rank"), F.array_join(own, " * ").alias("events"), F.size(own).cast("long").alias("order"))


def expanded(tree_tops: DataFrame, most: int = 20) -> DataFrame:
    """(event_tree, sequence, place, top, state): every path through the tops(event_tree, place, top) of a tree.

    A tree of n tops has 2^n paths, numbered with success first; a tree of over `most` tops is an error."""
    n = tree_tops.groupBy("event_tree").agg(F.max("place").alias("n"))
    if not n.filter(F.col("n") > most).isEmpty():
        raise ValueError(f"an event tree has over {most} tops")
    paths = n.select("event_tree", "n", F.explode(F.expr("sequence(0, shiftleft(1, CAST(n AS INT)) - 1)")).alias("path"))
    failed = F.expr("shiftright(path, CAST(n - place AS INT)) & 1") == 1
    rows = paths.join(tree_tops, "event_tree")
    return rows.select("event_tree", (F.col("path") + 1).cast("long").alias("sequence"), "place", "top", F.when(failed, "failure").otherwise("success").alias("state"))


def frequencies(paths: DataFrame, chances: DataFrame, initiators: DataFrame) -> DataFrame:
    """(event_tree, sequence, failures, frequency): the initiator's frequency times the chances along each path.

    paths: event_tree, sequence, top, state; chances: event_tree, top, p (of failure); initiators: event_tree, frequency."""
    own = F.when(F.col("state") == "failure", F.col("p")).otherwise(1 - F.col("p"))
    rows = paths.join(chances, ["event_tree", "top"]).groupBy("event_tree", "sequence").agg(F.product(own).alias("c"), F.count_if(F.col("state") == "failure").alias("failures"))
    return rows.join(initiators, "event_tree").select("event_tree", "sequence", "failures", (F.col("frequency") * F.col("c")).alias("frequency"))
