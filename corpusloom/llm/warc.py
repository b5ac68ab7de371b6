"""Operator 8, WARC files: writing them, and reading them back by boundary-chain verification.

Writing is Spark's own text sink, whose line separator is set to the two line ends that close a record, so archives go
to any store that Spark writes to. Reading splits files by byte ranges: the record magic is the separator of Spark's
text source, so a task gets what lies between the magics of its range, however large the file. Each task emits, for
every place that has the magic, a candidate (offset, successor's offset) from that place's own header, and follows the
chains of its range to where they leave it. Pointer jumping then runs over those leaps, as joins, from each file's
start; what it does not reach is rejected, such as a magic inside a payload, whose pieces are put together again.

Defined cases: null html is an empty payload; pages without an id cannot be referred to and are written as responses;
of rows with equal id and payload each is a record; extra columns are ignored; an empty table gives no archive; a
record that is cut off, and all that follows it in its file, is not read. No WARC-Date is written, since a page has none."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, shared_folder, table

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
# Fixed value: the profile of a revisit of an identical payload (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always written in full.
LEAST = 1000
#: Records an archive holds at most.
RECORDS = 50_000
#: Digests of copied payloads (about 100 bytes each) and byte ranges of files (about 200) that may be broadcast.
BROADCAST_DIGESTS, BROADCAST_RANGES = 500_000, 200_000


def few(df: DataFrame, most: int) -> DataFrame:
    """The rows, to be broadcast if they are counted to be few enough."""
    return F.broadcast(df) if df.count() <= most else df


def record_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """One row per page: page_id, kind, refers_to and the text of its record up to the closing line ends.

    Only a digest and an id a page are shuffled to find the copies; equal digests are folded before the shuffle. Pages
    themselves are shuffled only where too many payloads have copies for a broadcast."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    copied = cut(rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    identity = F.when(F.col("page_id").isNull(), F.lit("none")).otherwise(F.col("page_id").cast("string"))
    return (
        rows.join(few(copied, BROADCAST_DIGESTS), "digest", "left")
        .withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(revisit, F.col("first")))
        .select(
            "page_id", "kind", "refers_to",
            F.concat(
                F.lit("WARC/1.1\r\n"),
                line("WARC-Type", F.col("kind")),
                line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), identity, F.lit(">"))),
                line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
                line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                line("X-Payload-Length", F.col("bytes")),
                F.when(F.col("kind") == "revisit", F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
                line("Content-Length", F.when(F.col("kind") == "revisit", F.lit(0)).otherwise(F.col("bytes"))),
                F.lit("\r\n"),
                F.when(F.col("kind") == "revisit", F.lit("")).otherwise(F.col("html")),
            ).alias("record"),
        )
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST, records: int = RECORDS, **columns: str) -> None:
    """Write archives under a path of any store; each closes with the last record's line ends."""
    rows = record_rows(pages, least=least, **columns).select("record")
    rows.write.option("lineSep", END).option("maxRecordsPerFile", records).mode("overwrite").text(path)


HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
FIELDS = [("page_id", pa.int64()), ("uri", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("sound", pa.bool_())]
FIELDS_DDL = "page_id long, uri string, kind string, refers_to long, payload_bytes long, payload_digest string, payload binary, sound boolean"
PIECES = [("file", pa.string()), ("at", pa.int64()), ("place", pa.int64()), ("data", pa.binary())]
PIECES_DDL = "file string, at long, place long, data binary"


def body(head: bytes) -> int | None:
    """Bytes from the end of the magic to the end of the record, whose header is given without its empty line."""
    size = dict(HEADER.findall(head + b"\r\n")).get(b"Content-Length", b"")
    return len(head) + 4 + int(size) + 4 if size.isdigit() else None


def batches_of(rows, fields: list, most: int = 1 << 22):
    """Record batches of some 4 MB from tuples."""
    some, weight = [], 0
    for r in rows:
        some.append(r)
        weight += 100 + sum(len(x) for x in r if isinstance(x, bytes))
        if weight > most:
            yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(zip(*some), fields)], names=[f[0] for f in fields])
            some, weight = [], 0
    if some:
        yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(zip(*some), fields)], names=[f[0] for f in fields])


def between_magics(spark: SparkSession, path: str) -> DataFrame:
    """(file, start of the byte range, value): what lies between magics, in the order of the file within a range."""
    lines = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def leaps(places: list[int], successors: list[int | None]) -> tuple[list[int | None], list[int | None]]:
    """Where each candidate's chain leaves the range, and the last candidate before; None where a chain breaks off, though
    the records before that are sound."""
    out: list = [None] * len(places)
    last: list = [None] * len(places)
    known = {p: k for k, p in enumerate(places)}
    for k in range(len(places) - 1, -1, -1):
        s = successors[k]
        if s in known and known[s] > k:
            out[k], last[k] = out[known[s]], last[known[s]]
        elif s is not None and s > places[-1]:
            out[k], last[k] = s, places[k]
    return out, last


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (file, range, at, leap, last) and ranges (file, range, base, size).

    Tasks know offsets only from their range's first magic on; `base`, the sum of what earlier ranges hold, makes
    them absolute. Headers alone come to Python."""
    fields = [("file", pa.string()), ("range", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("leap", pa.int64()), ("last", pa.int64())]
    n = len(MAGIC)

    def found(batches):
        def rows():
            at, place, total, places, successors = None, 0, [], [], []

            def closed():
                out, last = leaps(places, successors)
                for k, size in enumerate(total):
                    yield *at, places[k], size, out[k], last[k]

            for b in batches:
                for file, start, size, head in zip(*(c.to_pylist() for c in b.columns)):
                    if at != (file, start):
                        yield from closed()
                        at, place, total, places, successors = (file, start), 0, [], [], []
                    ends = None if head is None else body(head)
                    places.append(place - n)
                    successors.append(None if ends is None else place + ends)
                    total.append(size + n)
                    place += size + n
            yield from closed()

        yield from batches_of(rows(), fields)

    value = F.col("value")
    head = F.when(F.instr("value", END) > 0, F.substring_index(value, END, 1)).cast("binary")
    rows = cut(between_magics(spark, path).select("file", "range", F.octet_length("value").cast("long"), head.alias("head")).mapInArrow(found, "file string, range long, place long, size long, leap long, last long"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(rows.groupBy("file", "range").agg(F.sum("size").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0))))
    absolute = rows.drop("size").join(few(ranges, BROADCAST_RANGES), ["file", "range"])
    return absolute.select("file", "range", *((F.col("base") + F.col(c)).alias(x) for c, x in (("place", "at"), ("leap", "leap"), ("last", "last")))).filter("at >= 0"), ranges


def reached(found: DataFrame) -> DataFrame:
    """The candidates (file, range, at, leap, last) at which chains from the files' starts enter a range.

    Pointer jumping: each round adds what the reached ones leap to and doubles the length of all leaps."""
    found = cut(found)
    start = found.filter("at = 0").select("file", "at")
    entries = cut(found.join(found.select("file", F.col("leap").alias("at")).unionByName(start).distinct(), ["file", "at"]))
    jump, seen, n = entries.select("file", "at", "leap"), cut(start), -1
    while (now := seen.count()) != n:
        n = now
        step = seen.join(jump, ["file", "at"]).select("file", F.col("leap").alias("at")).join(entries, ["file", "at"], "left_semi")
        seen = cut(seen.unionByName(step).distinct())
        jump = cut(jump.alias("x").join(jump.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.leap") == F.col("y.at"))).select("x.file", "x.at", "y.leap"))
    return cut(entries.join(seen, ["file", "at"], "left_semi"))


def record(data: bytes, payloads: bool) -> tuple:
    """The fields of a record, whose bytes are given from the end of the magic on."""

    def number(raw: bytes) -> int | None:
        m = re.fullmatch(rb"<urn:page:(-?\d+)>", raw)
        return int(m[1]) if m else None

    stop = data.index(b"\r\n\r\n")
    head, payload = dict(HEADER.findall(data[: stop + 2])), data[stop + 4 : -4]
    kind, said = head.get(b"WARC-Type", b"").decode(), head.get(b"WARC-Payload-Digest", b"").decode()
    if kind == "revisit":
        digest, size, sound = said.removeprefix("sha1:"), int(head.get(b"X-Payload-Length", b"0")), True
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        sound = said == f"sha1:{digest}"
    return number(head.get(b"WARC-Record-ID", b"")), head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), kind, number(head.get(b"WARC-Refers-To", b"")), size, digest, payload if payloads else None, sound


def walk(batches):
    """Follows the chain through each range: (file, at, place, bytes, whole) of records, or of pieces of those that leave it.

    Rows: file, range, value, base, entry (offset of the first record), owner and until (a record from an earlier
    range, and its end)."""
    at, here, wanted, open_, n = None, 0, None, None, len(MAGIC)
    for b in batches:
        for file, start, value, base, entry, owner, until in zip(*(c.to_pylist() for c in b.columns)):
            if at != (file, start):
                if open_:
                    yield *open_[:3], b"".join(open_[4]), False
                at, here, wanted, open_ = (file, start), base, entry, None
            place, here = here, here + len(value) + n
            if place - n == wanted:
                stop = value.find(b"\r\n\r\n")
                size = body(value[:stop]) if stop >= 0 else None
                if size is None:  # a header that says no length: the chain ends before it
                    wanted = None
                    continue
                wanted = place + size
                open_ = (file, place - n, place, wanted, [value])
            elif open_:
                open_[4].append(MAGIC + value)
            elif owner is not None and place - n < until:
                yield file, owner, place - n, (MAGIC + value)[: until - place + n], False
                continue
            if open_ and place + len(value) >= open_[3]:
                data = b"".join(open_[4])[: open_[3] - open_[2]]
                yield *open_[:3], data, data.endswith(b"\r\n\r\n")
                open_ = None
    if open_:
        yield *open_[:3], b"".join(open_[4]), False


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per verified record: page_id, uri, kind, refers_to, payload_bytes, payload_digest, payload, sound.

    Response payloads are digested anew; `sound` says whether that agrees with the header. Without `payloads` that
    column is null."""
    found, ranges = candidates(spark, path)
    entered = reached(found)
    entry = entered.groupBy("file", "range").agg(F.min("at").alias("entry"))
    # Ranges that begin within a record of an earlier one, which has the magic in its payload.
    ends = ranges.select("file", "range", (F.col("base") + F.col("size") - len(MAGIC)).alias("end"))
    over = entered.join(ends, ["file", "range"]).filter("leap > end").select("file", F.col("range").alias("first"), F.col("last").alias("owner"), F.col("leap").alias("until"))
    within = ranges.join(over, "file").filter((F.col("range") > F.col("first")) & (F.col("base") - len(MAGIC) < F.col("until"))).select("file", "range", "owner", "until")
    plan = cut(ranges.join(entry, ["file", "range"], "left").join(within, ["file", "range"], "left").select("file", "range", "base", "entry", "owner", "until").filter("entry is not null or owner is not null"))
    lines = between_magics(spark, path).join(few(plan, BROADCAST_RANGES), ["file", "range"])
    lines = lines.select("file", "range", F.col("value").cast("binary"), "base", "entry", "owner", "until")

    def whole(batches):
        yield from batches_of((record(data, payloads) for _, _, _, data, ok in walk(batches) if ok), FIELDS)

    def pieces(batches):
        yield from batches_of((r[:4] for r in walk(batches) if not r[4]), PIECES)

    def joined(batches):
        datas = (b"".join(b["d"] for b in sorted(r, key=lambda b: b["p"])) for b in batches for r in b.columns[0].to_pylist())
        full = ((d, body(d[: max(0, d.find(b"\r\n\r\n"))])) for d in datas)
        yield from batches_of((record(d, payloads) for d, size in full if size == len(d) and d.endswith(b"\r\n\r\n")), FIELDS)

    records = lines.mapInArrow(whole, FIELDS_DDL)
    if plan.filter("owner is not null").count():
        parts = lines.mapInArrow(pieces, PIECES_DDL).groupBy("file", "at").agg(F.collect_list(F.struct(F.col("place").alias("p"), F.col("data").alias("d"))).alias("parts"))
        records = records.unionByName(parts.select("parts").mapInArrow(joined, FIELDS_DDL))
    return records


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "sound")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to, true AS sound
FROM r
"""
