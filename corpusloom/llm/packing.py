"""Operator 7, token-id output: best-fit-decreasing packing of token segments into rows of one length.

Documents are encoded, those longer than a row are split into whole rows and a rest, and the segments of a buffer are
placed, longest first, into the row whose free room is the smallest that fits. A segment tree over free capacities finds
that room in log(length) steps. Each packed row carries its ids as a little-endian matrix row, the cumulative segment
lengths and the places where positions start again, with the document and offset of each segment, so nothing is lost.

Buffers are bounded in tokens and a task packs its own, so nothing is shuffled and rows come out as documents go in.

Defined cases: a null or empty text has no segment; equal rows are packed each; segments of equal length keep the order
of their documents; extra columns are ignored; an empty table gives no row."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Tokens of a row, and tokens that a task holds before it packs them.
LENGTH, BUFFER = 2048, 2_000_000


class Capacities:
    """A segment tree over free capacities 0..length: how many open rows have each, and the least that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that some row has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Best-fit-decreasing: for each row the numbers of its segments, in the order they were placed."""
    tree, rows, free = Capacities(length), [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        room = tree.least(sizes[k])
        if room is None:
            rows.append([k])
            at, room = len(rows) - 1, length
        else:
            at = free[room].pop()
            rows[at].append(k)
            tree.add(room, -1)
        left = room - sizes[k]
        if left:
            free.setdefault(left, []).append(at)
            tree.add(left, 1)
    return rows


@lru_cache(maxsize=2)
def encoding(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(doc: int | None, ids: np.ndarray, length: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document, offset, ids): whole rows of a document, then its rest."""
    for k in range(0, len(ids), length):
        yield doc, k, ids[k : k + length]


def packed_rows(found: Iterable[tuple[int | None, int, np.ndarray]], length: int, buffer: int) -> Iterator[list[tuple[int | None, int, np.ndarray]]]:
    held, tokens = [], 0
    for s in found:
        held.append(s)
        tokens += len(s[2])
        if tokens >= buffer:
            yield from ([held[k] for k in row] for row in pack([len(s[2]) for s in held], length))
            held, tokens = [], 0
    yield from ([held[k] for k in row] for row in pack([len(s[2]) for s in held], length))


DDL = "part int, row_no long, n_tokens int, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary, ids_sha256 string"


def pack_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, length: int = LENGTH, pad: int = 50256, buffer: int = BUFFER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row. `ids` holds `length` unsigned 16-bit ids, padded with `pad` after cu_seqlens[-1]; positions
    count from 0 again at each of position_resets."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def rows(batches):
        from pyspark import TaskContext

        encode = encoding(*shared.value).encode_ordinary
        part = TaskContext.get().partitionId()

        def found():
            for b in batches:
                for k in range(0, b.num_rows, 200):
                    for i, t in zip(b.columns[0][k : k + 200].to_pylist(), b.columns[1][k : k + 200].to_pylist()):
                        if t:
                            yield from segments(i, np.array(encode(t), np.uint16), length)

        out, n = [], 0
        for row in packed_rows(found(), length, buffer):
            ids = np.full(length, pad, np.uint16)
            ends = np.cumsum([len(s[2]) for s in row])
            ids[: ends[-1]] = np.concatenate([s[2] for s in row])
            raw = ids.astype("<u2").tobytes()
            starts = [0, *ends[:-1].tolist()]
            out.append((part, n, int(ends[-1]), [s[0] for s in row], [s[1] for s in row], [0, *ends.tolist()], starts, raw, hashlib.sha256(raw).hexdigest()))
            n += 1
            if len(out) >= 500:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.string()]
    names = [x.split()[0] for x in DDL.split(", ")]
    batch = lambda out: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(rows, DDL)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet under a path of any store."""
    pack_documents(docs, **options).write.mode("overwrite").parquet(path)


def unpack(rows: DataFrame) -> DataFrame:
    """(doc_id, offset, ids) of every segment of packed rows: the inverse of packing."""

    def out(batches):
        for b in batches:
            docs, offsets, ends, raw = (b.column(k).to_pylist() for k in ("doc_ids", "doc_offsets", "cu_seqlens", "ids"))
            found = [(d, o, np.frombuffer(r, "<u2")[s:e].tolist()) for ds, os_, es, r in zip(docs, offsets, ends, raw) for d, o, s, e in zip(ds, os_, es, es[1:])]
            yield pa.record_batch([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["doc_id", "offset", "ids"])

    return rows.select("doc_ids", "doc_offsets", "cu_seqlens", "ids").mapInArrow(out, "doc_id long, offset long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
