"""Operator 13: main text of web pages by wrappers inferred from the pages of a host.

Each page becomes a tree of blocks, and its repetitions are folded into a union-free expression; pages of a host that have
the same expression are counted as one. Expressions of a host are then aligned with one another, some dozens a group and
in rounds until one is left: the host's wrapper, whose optional and repeated parts and text slots hold every page of the
host. What its slots hold is summed over all pages; a slot is main text by its place in the wrapper, and a slot with the
same text on every page is template. The pages are parsed once, and their html is never shuffled."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, lean, table
from corpusloom.llm.html_tree import CHROME_TAGS, CHROME_WORDS, HEADINGS, MAIN_WORDS, Item, parse
from corpusloom.llm.wrappers import align, dump, infer, load, show, slots

#: Expressions that one task aligns at a time; rounds go on until a host has one.
ALIGNED = 64
#: A text slot is template only if the host has so many different pages, and all of its pages have the slot with one text.
TEMPLATE_PAGES = 20
#: Kept slots are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 8 << 20
#: Characters of text after which a task passes its rows on.
PASS_ON = 4 << 20

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _pages(batches):
    """(page_id, url, html, host) to (page_id, url, host, expression, texts, slots, links)."""
    for batch in batches:
        rows, size = [], 0
        names = batch.schema.names
        at = [names.index(x) for x in ("page_id", "url", "host", "html")]
        for k in range(batch.num_rows):
            page_id, url, host, html = (batch.column(i)[k].as_py() for i in at)
            tree, texts, links = parse(html or "")
            tree = infer(tree)
            places = [0] * len(texts)
            for n, slot in enumerate(slots(tree)):
                for block in slot.ids:
                    places[block] = n
            rows.append((page_id, url, host, dump(tree), texts, places, links))
            size += sum(map(len, texts))
            if size > PASS_ON:
                yield _batch(rows, batch.schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, batch.schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field("page_id").type, schema.field("url").type, pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)], names=["page_id", "url", "host", "expression", "texts", "slots", "links"])


def parsed(scratch: Scratch, pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", "html", host.alias("host")).mapInArrow(
        lean(_pages), f"page_id {kinds['page_id']}, url {kinds['url']}, host string, expression string, texts array<string>, slots array<int>, links array<int>"
    )
    return scratch.put("pages", rows)


def _align(group: pd.DataFrame) -> pd.DataFrame:
    """The expressions of a bucket as one; map: where each slot of the old expression stands in the new one."""
    group = group.sort_values(["pages", "id"], ascending=[False, True])
    whole, sizes = None, []
    for n, text in enumerate(group["expression"]):
        tree = load(text)
        own = slots(tree)
        sizes.append(len(own))
        for k, slot in enumerate(own):
            slot.ids = [(n, k)]
        if whole is None:
            whole = tree
        else:
            whole.kids = align(whole.kids, tree.kids)
    maps = [[0] * size for size in sizes]
    for place, slot in enumerate(slots(whole)):
        for n, k in slot.ids:
            maps[n][k] = place
    expression = dump(whole)
    return pd.DataFrame({"host": group["host"], "id": group["id"], "expression": expression, "pages": group["pages"], "map": maps})


def wrappers(scratch: Scratch, expressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (host, expression, pages): ((host, expression) of each host's wrapper, (host, id, map) of each expression).

    A round aligns at most some ALIGNED expressions a task; each cuts a host's number by about that factor."""
    current = scratch.put("round0", expressions.select("host", F.md5("expression").alias("id"), "expression", "pages"))
    maps = None
    k = 0
    while True:
        counts = current.groupBy("host").agg(F.count("*").alias("n"))
        if maps is not None and counts.filter("n > 1").isEmpty():
            return current.select("host", "expression"), maps
        k += 1
        bucket = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ALIGNED)).cast("int")
        dealt = current.join(counts, "host").select("host", "id", "expression", "pages", bucket.alias("bucket"))
        done = scratch.put(f"aligned{k}", dealt.groupBy("host", "bucket").applyInPandas(_align, "host string, id string, expression string, pages bigint, map array<int>"))
        new = F.md5("expression")
        if maps is None:
            maps = done.select("host", "id", "map", new.alias("now"))
        else:
            step = done.select("host", F.col("id").alias("now"), F.col("map").alias("_step"), new.alias("_new"))
            maps = maps.join(step, ["host", "now"]).select("host", "id", F.transform("map", lambda x: F.get("_step", x)).alias("map"), F.col("_new").alias("now"))
        maps = scratch.put(f"maps{k}", maps)
        current = scratch.put(f"round{k}", done.groupBy("host", new.alias("id")).agg(F.first("expression").alias("expression"), F.sum("pages").alias("pages")))


def _words(sig: str) -> set[str]:
    return set(sig.split(".")[1:])


def _holds_main(item: Item) -> bool:
    """Whether an article or main element that is no comment lies below."""
    return any((k.sig.split(".")[0] in ("article", "main") and not _words(k.sig) & {"comment", "comments"}) or _holds_main(k) for k in item.kids)


def chosen(root: Item, stats: list[tuple[int, int, bool]]) -> list[bool]:
    """Of each text slot of an expression whether it is main text. stats: characters, those in links, same text on all pages.

    Menus, footers, sidebars, forms and whatever a class, id or role calls a header, notice, advert or comment is none,
    nor is a header but for the headings of an article's own. Of the rest it is what lies in articles, or in a main
    element that holds more outside of them; else in the element named as content; else all but lists of links."""
    places: list[dict] = []

    def walk(item: Item, chrome: bool, regions: tuple, inside: bool, header: bool, repeated: bool, box: int, heading: bool):
        name, words = item.sig.split(".")[0], _words(item.sig)
        repeated = repeated or item.rep
        if item.sig == "#":
            places.append({"chrome": chrome or (header and not heading), "regions": regions, "repeated": repeated, "box": box, "heading": heading})
            return
        if name == "header":
            header = True
            chrome = chrome or not inside
        elif name in CHROME_TAGS:
            chrome = True
        elif words & {"comment", "comments", "disqus", "respond", "replies"} and not (name in ("main", "body") or _holds_main(item)):
            chrome = True
        elif words & CHROME_WORDS and name not in ("article", "main", "body") and name not in HEADINGS and not _holds_main(item):
            chrome = True
        if item.sig != "(" and not chrome:
            kind = "article" if name == "article" else "main" if name == "main" or "main" in words else "named" if words & MAIN_WORDS and name not in HEADINGS else None
            if kind:
                regions = (*regions, kind)
            inside = inside or name in ("article", "main")
        if name in ("div", "section", "ul", "ol", "table", "td", "menu"):
            box = id(item)
        for k in item.kids:
            walk(k, chrome, regions, inside, header, repeated, box, heading or name in HEADINGS)

    walk(root, False, (), False, False, False, id(root), False)
    open_ = [not p["chrome"] and not (stats[n][2] and not p["repeated"] and not p["heading"]) for n, p in enumerate(places)]

    def size(kind: str, other: str | None = None) -> int:
        return sum(stats[n][0] for n, p in enumerate(places) if open_[n] and kind in p["regions"] and other not in p["regions"])

    article, main = size("article"), size("main")
    kind = "main" if main and (not article or size("main", "article") > article) else "article" if article else "named" if size("named") else None
    if kind:
        return [o and kind in p["regions"] for o, p in zip(open_, places)]
    boxes: dict[int, list[int]] = {}
    for n, p in enumerate(places):
        both = boxes.setdefault(p["box"], [0, 0])
        both[0] += stats[n][0]
        both[1] += stats[n][1]
    return [o and 2 * boxes[p["box"]][1] <= boxes[p["box"]][0] for o, p in zip(open_, places)]


def _decide(frames):
    """Rows with an expression and what its slots hold to rows with what is kept of each slot."""
    for frame in frames:
        kept = []
        for text, sums in zip(frame["expression"], frame["stats"]):
            root = load(text)
            stats = [(0, 0, False)] * len(slots(root))
            for s in sums if sums is not None else []:
                stats[s["slot"]] = (s["chars"], s["links"], bool(s["same"]))
            kept.append(chosen(root, stats))
        yield pd.DataFrame({"host": frame["host"], "id": frame["id"], "kept": kept})


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Sums over slots as one array a row of `by`; template text is one text on all of a host's pages, which differ."""
    same = (F.min("least") == F.max("most")) & (F.max("different") >= TEMPLATE_PAGES) & (F.sum("pages") == F.max("all_pages"))
    slot = rows.groupBy(*by, "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), same.alias("same"))
    return slot.groupBy(*by).agg(F.collect_list(F.struct("slot", "chars", "links", "same")).alias("stats"))


def kept_slots(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, id, kept): what to keep of each slot of each expression, by the wrapper of its host.

    An expression of which the wrapper keeps nothing, as a page without an article on a host of articles, is decided by
    itself."""
    own = F.md5("expression").alias("id")
    # one row an expression and host: counted before the shuffle
    expressions = scratch.put("expressions", pages.groupBy("host", "expression").agg(F.count("*").alias("pages")))
    different = pages.groupBy("host").agg(F.count("*").alias("all_pages"), F.approx_count_distinct(F.xxhash64("texts")).alias("different"))
    blocks = pages.select("host", own, F.explode(F.arrays_zip("slots", "texts", "links")).alias("b"))
    text = F.xxhash64("b.texts")
    blocks = blocks.groupBy("host", "id", F.col("b.slots").alias("slot")).agg(
        F.sum(F.length("b.texts")).alias("chars"), F.sum("b.links").alias("links"), F.min(text).alias("least"), F.max(text).alias("most")
    )
    counted = expressions.select("host", own, "pages")
    blocks = scratch.put("blocks", blocks.join(counted, ["host", "id"]).join(different, "host"))
    tops, maps = wrappers(scratch, expressions)
    mapped = blocks.join(maps.select("host", "id", "map"), ["host", "id"]).withColumn("slot", F.get("map", F.col("slot")))
    top = tops.join(_sums(mapped, "host"), "host", "left").withColumn("id", F.lit(""))
    by_host = top.select("host", "id", "expression", "stats").mapInPandas(_decide, "host string, id string, kept array<boolean>")
    alone = expressions.select("host", own, "expression").join(_sums(blocks, "host", "id"), ["host", "id"], "left")
    by_itself = alone.select("host", "id", "expression", "stats").mapInPandas(_decide, "host string, id string, kept array<boolean>")
    rows = maps.select("host", "id", "map").join(by_host.select("host", F.col("kept").alias("all")), "host").join(by_itself, ["host", "id"])
    by_wrapper = F.transform("map", lambda x: F.get("all", x))
    return scratch.put("kept", rows.select("host", "id", F.when(F.exists(by_wrapper, lambda x: x), by_wrapper).otherwise(F.col("kept")).alias("kept")))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text of its html, blocks joined by two line feeds.

    A null or empty html gives an empty text, as does a page without main text; a null url is a host of its own, as is
    what has no host. Pages are read whole, however long. Repeated rows give repeated results; an empty table gives
    none. Columns beyond page_id, url and html are ignored."""
    scratch = Scratch(pages.sparkSession, "html_extract")
    read = parsed(scratch, pages)
    kept = kept_slots(scratch, read)
    size = kept.agg(F.sum(F.length("host") + 60 + F.size("kept"))).first()[0] or 0
    kept = F.broadcast(kept) if size <= BROADCAST_BYTES else kept
    rows = read.withColumn("id", F.md5("expression")).join(kept, ["host", "id"], "left")
    mine = F.transform("texts", lambda t, i: F.when(F.get("kept", F.get("slots", i)), t))
    return rows.select("page_id", "url", F.array_join(mine, "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the union-free expression of each host as text."""
    scratch = Scratch(pages.sparkSession, "html_wrappers")
    expressions = parsed(scratch, pages).groupBy("host", "expression").agg(F.count("*").alias("pages"))
    tops, _ = wrappers(scratch, expressions)

    def shown(frames):
        for frame in frames:
            yield pd.DataFrame({"host": frame["host"], "wrapper": [show(load(x)) for x in frame["expression"]]})

    return tops.mapInPandas(shown, "host string, wrapper string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
