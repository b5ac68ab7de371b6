"""Operator 2, BPE encoding and decoding by a streaming transducer with bounded lookahead.

A merge list decides how far to the right of a token anything can still change it. That distance, the sufficient
lookahead, is computed once from the list; the transducer keeps only that much text beyond what it has emitted, so its
memory does not grow with a word or a text. Decoding is an incremental byte-to-text machine that holds back at most
the bytes of one unfinished code point.

Defined cases: null is the empty text, which has no tokens; the special tokens' own strings in a text become their ids,
as in the library; extra columns are ignored; equal rows are encoded alike."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import by_ids, lean, table

#: Words whose tokens are kept, and the longest of them; all others go through the transducer again.
CACHED, CACHED_CHARS = 100_000, 64
#: Symbols that the transducer takes in at a time beyond its lookahead, and characters of text split at a time.
STEP, SLICE = 256, 1 << 16
#: The rank of a pair that no merge joins.
NO_RULE = 1 << 30

# Code points that the tokenizers library holds to be neither letters nor numbers (its classes are those of
# Unicode 16), whatever a later version of the regex module says of them.
UNASSIGNED = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
# Capitals newer than Unicode 15.1 and their small letters, which the library lowers, in runs.
NEWER_CAPITALS = (
    "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"
)


def code_points(runs: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (r.partition("-") for r in runs.split())]


NEWER_LOWER = {
    a + k: int(small, 16) + k for run, _, small in (x.partition(":") for x in NEWER_CAPITALS.split()) for a, b in code_points(run) for k in range(b - a + 1)
}
NEWER = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
# The two splitting patterns of the tokenizer files.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Text with no character that this finds (all below U+0250, no fractions, superscripts or odd controls) is split by the faster pattern.
WIDE = re.compile("[^\x00-\x1b\x20-ɏ]|[²³¹¼-¾]")
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_WORDS = re.compile(rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{_L}0-9]+")


def as_in_unicode_16(pattern: str) -> regex.Pattern:
    """The pattern with its letters and numbers taken from Unicode 16."""
    no = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in code_points(UNASSIGNED)) + "]"
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", "\0")
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(f"[{kind}]", kind).replace(kind, f"[{kind}--{no}]")
    return regex.compile(pattern.replace("\0", rf"[[^\s\p{{L}}\p{{N}}]||{no}]"), regex.V1)


ANY_WORDS = as_in_unicode_16(WORDS)
ANY_PIECES = as_in_unicode_16(PIECES)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's merges, its symbols and the lookahead that the merges need."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.ids | self.special).items()}
        self.symbols = byte_symbols()
        self.starts, self.ends = ([self.ids[c + e] for c in self.symbols] for e in ("", self.end))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.ranks = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self.made = dict(self.pairs.values())
        self.lookahead = self._lookahead()
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _lookahead(self) -> int:
        """The most symbols after a token's end that can decide whether it stands.

        A rule (a, b) is stopped by a rule of a higher rank that takes the end of b away to the right, which may be
        stopped in turn; ranks fall along such a chain, so one pass in order of rank finds the longest."""
        length: dict[int, int] = {}
        right: dict[int, int] = {}
        reach: dict[int, int] = {}
        for (a, b), (_, new) in self.pairs.items():
            size_b = length.get(b, 1)
            length[new] = length.get(a, 1) + size_b
            right.setdefault(new, b)
            beyond, at = 0, b
            while at is not None:
                beyond = max(beyond, reach.get(at, 0))
                at = right.get(at)
            reach[a] = max(reach.get(a, 0), size_b + beyond)
        return max(reach.values(), default=0)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a short run of symbols, lowest rank first, leftmost first.

        The ranks of adjacent pairs stand beside the symbols, and a merge changes those of its two neighbours only."""
        symbols, rank, made = list(symbols), self.ranks.get, self.made
        ranks = list(map(rank, zip(symbols, symbols[1:]), repeat(NO_RULE)))
        while ranks and (best := min(ranks)) != NO_RULE:
            k = ranks.index(best)
            symbols[k : k + 2] = (made[best],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank((symbols[k - 1], symbols[k]), NO_RULE)
            if k < len(ranks):
                ranks[k] = rank((symbols[k], symbols[k + 1]), NO_RULE)
        return symbols

    def to_symbols(self, piece: str) -> Iterator[int]:
        """The starting symbols of a piece, one a byte; the last carries the end mark if the file has one."""
        raw = piece.encode("utf-8", "surrogatepass")
        last = max(0, len(raw) - 1)
        return chain(map(self.starts.__getitem__, islice(raw, last)), map(self.ends.__getitem__, raw[last:]))


class Transducer:
    """Symbols in, token ids out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.width = {i: len(s.removesuffix(vocabulary.end)) if vocabulary.end else len(s) for s, i in vocabulary.ids.items()}

    def run(self, symbols: Iterable[int]) -> Iterable[int]:
        """Takes in symbols up to a step beyond the lookahead; an input that ends before that is stable as a whole."""
        source = iter(symbols)
        room = self.v.lookahead + STEP
        kept = list(islice(source, room))
        return self.v.merge(kept) if len(kept) < room else self.stream(kept, source, room)

    def stream(self, kept: list[int], source: Iterator[int], room: int) -> Iterator[int]:
        """The tokens that no symbol beyond the lookahead can change, emitted before more is taken in."""
        while len(kept) >= room:
            at = 0
            for t in self.v.merge(kept):
                w = self.width[t]
                if at + w + self.v.lookahead > len(kept):
                    break
                yield t
                at += w
            kept = kept[at:]
            if not at:  # a token longer than a step: take more in
                room += STEP
            kept += islice(source, room - len(kept))
        yield from self.v.merge(kept)


class Words(dict):
    """Piece -> (ids as text, token strings); bounded, refilled by the transducer.

    A full table becomes the older one, from which pieces that come again are taken back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.transducer = vocabulary, Transducer(vocabulary)
        self.older: dict[str, tuple[str, str]] = {}

    def ids_of(self, piece: str) -> Iterable[int]:
        return self.transducer.run(self.v.to_symbols(piece))

    def __missing__(self, piece: str) -> tuple[str, str]:
        found = self.older.pop(piece, None)
        if found is None:
            ids = list(self.ids_of(piece))
            found = " ".join(map(str, ids)), " ".join(map(self.v.names.__getitem__, ids))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Texts to tokens and back for one tokenizer file."""

    def __init__(self, raw: bytes):
        self.v = Vocabulary(raw)
        self.words = Words(self.v)

    def normal(self, text: str) -> str:
        if not self.v.end:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character is lowered alone
            if NEWER.search(text):
                text = text.translate(NEWER_LOWER)
        return text.lower()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text that has no special token, some at a time."""
        text = self.normal(text)
        if not self.v.end:
            find = ANY_PIECES.findall
        else:
            find = ANY_WORDS.findall if WIDE.search(text) else LATIN_WORDS.findall
        at = 0
        while at < len(text):
            to = at + SLICE
            if to < len(text):
                to = self._break(text, to)
            yield find(text[at:to] if at or to < len(text) else text)
            at = to

    def _break(self, text: str, to: int) -> int:
        """The next place where no piece can reach across: before a single space that stands between other characters."""
        while (to := text.find(" ", to)) > 0:
            if not text[to - 1].isspace() and to + 1 < len(text) and not text[to + 1].isspace():
                return to
            to += 1
        return len(text)

    def encode(self, text: str | None) -> Iterator[list[tuple[str, str]]]:
        """Word entries (ids as text, token strings), some at a time."""
        at = 0
        for m in self.v.splitter.finditer(text or "") if self.v.splitter else ():
            for some in self.pieces(text[at : m.start()]):
                yield list(map(self.words.__getitem__, some))
            i = self.v.special[m[0]]
            yield [(str(i), m[0])]
            at = m.end()
        for some in self.pieces((text or "")[at:]):
            yield list(map(self.words.__getitem__, some))

    def ids(self, text: str | None) -> Iterator[int]:
        for some in self.encode(text):
            for entry in some:
                yield from map(int, entry[0].split(" "))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the decoded text; both texts are hashed as they arise."""
        n, ids, decoder = 0, hashlib.sha256(), Decoder(self.v)
        decoded = hashlib.sha256()
        for some in self.encode(text):
            if some:
                said, names = map(" ".join, zip(*some))
                ids.update(((" " if n else "") + said).encode())
                decoded.update(decoder.surfaces(names).encode())
                n += said.count(" ") + 1
        decoded.update(decoder.end().encode())
        return n, ids.hexdigest(), decoded.hexdigest()


class Decoder:
    """Token ids in, text out; it keeps no more than the bytes of an unfinished code point."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.back = {c: b for b, c in enumerate(vocabulary.symbols)}
        self.begun = False

    def surfaces(self, names: str) -> str:
        """Token strings joined by one space, as a file without a decoder has it; goes on from the last call."""
        lead, self.begun = " " if self.begun else "", True
        return self.machine.decode((lead + names).encode("utf-8", "surrogatepass"))

    def text(self, ids: Iterable[int]) -> str:
        """The bytes that tokens stand for, the end of a word being a space; goes on from the last call."""
        out = bytearray()
        for i in ids:
            name = self.v.names[i]
            if i in self.v.special.values():
                out += name.encode()
                continue
            ends = bool(self.v.end) and name.endswith(self.v.end)
            out += bytes(self.back[c] for c in (name.removesuffix(self.v.end) if ends else name))
            if ends:
                out += b" "
        return self.machine.decode(bytes(out))

    def end(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(raw: bytes) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    return Encoder(raw)


def tokenizer_bytes(path: str | None = None, name: str = "word_bpe_49k.json") -> bytes:
    """The tokenizer file, read by the driver and sent to the executors (under 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    A map over the documents: no shuffle, and a row needs memory for its own text only."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def encoded(batches):
        e = encoder(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                ids, texts = b.columns[0][k : k + 200], b.columns[1][k : k + 200].to_pylist()
                columns = [ids, *(pa.array(c, f.type) for c, f in zip(zip(*map(e.digest, texts)), list(schema)[1:]))]
                if with_ids:
                    columns.append(pa.array([list(e.ids(t)) for t in texts], pa.list_(pa.int32())))
                yield pa.record_batch(columns, schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(encoded), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: what is left, encoded."""
    return encode_documents(docs)
