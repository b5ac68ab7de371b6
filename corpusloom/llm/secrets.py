"""Operator 3, secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags words as O (outside), B (secret begins) or I (inside). A word's features are its own shape, the shapes
of its neighbours and features of the whole file. It is trained on a bounded sample of documents whose tags come from
the fixed patterns, and on copies of what they tag with the cue spoilt: the sign between name and value lost or a plain
word, or, where the value's own shape tells, name and sign lost. Copies with a plain or short value are no secrets, and
untagged words of a telling shape teach nothing. So the field finds what no pattern spells out. Viterbi runs on windows
about the words of a conspicuous shape only: farther away than the model's margin allows, O is certain; where there is
no such margin it runs on whole texts.

Defined cases: a null or empty text has no spans; offsets are code points; equal rows give equal results; extra columns
are ignored; an empty table, or one with no example, gives a field that adds nothing."""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

# The base patterns and the least sizes of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

NAMES = {"password", "passwd", "secret", "token", "apikey", "api_key", "pwd", "key", "auth", "bearer", "credential", "pass"}
EDGE = "\"'`.,;:()[]{}<>!?*#$%&|"
PLAIN, NAME, SIGN, JOINED, HEX24, HEX8, UPPER16, UPPER, DIGITS4, DIGITS12, DIGITS, MIXED16, MIXED, BASE64, MAIL, LINK, NUMERIC, OUT = range(18)
#: Features of the whole file: signs of code, many digits, none of these.
FILES = 3
#: Shapes that tell a secret without a cue.
TELLING = (HEX24, UPPER16, MIXED16, BASE64)
O, B, I = range(3)
NEVER = -1e9


def shape(word: str) -> int:
    """The class of a word's form; bit 5 is set if it holds a run of 24 hex digits."""
    core = word.strip(EDGE)
    low = core.lower()
    hexed = 32 if len(word) >= 24 and HEX_LONG.search(word) else 0
    if not core:
        return (SIGN if set(word) & set(":=") else PLAIN) | hexed
    if low in NAMES:
        return NAME | hexed
    if set(core) <= set("=:>-"):
        return SIGN | hexed
    if ("=" in core or ":" in core) and any(k in low for k in KEYWORDS):
        return JOINED | hexed
    if not any(c.isdigit() for c in core):
        return (BASE64 if len(core) >= 24 and core.isascii() and any(c in "+/_=-" for c in core) and "://" not in core else PLAIN) | hexed
    if "://" in core:
        return LINK | hexed
    if "@" in core:
        return MAIL | hexed
    if core.isdigit():
        return (DIGITS4 if len(core) <= 4 else DIGITS12 if len(core) <= 12 else DIGITS) | hexed
    if hexed and HEX.fullmatch(core):
        return HEX24 | hexed
    if HEX.fullmatch(core):
        return HEX8 | hexed
    if core.isalnum():
        if core == core.upper():
            return (UPPER16 if len(core) >= 16 else UPPER) | hexed
        return (MIXED16 if len(core) >= 16 else MIXED) | hexed
    if len(core) >= 20 and any(c.isalpha() for c in core):
        return BASE64 | hexed
    return (NUMERIC if not any(c.isalpha() for c in core) else MIXED) | hexed


class Shapes(dict):
    """Word -> class, bounded."""

    def __missing__(self, word: str) -> int:
        found = shape(word)
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[word] = found
        return found


SHAPES = Shapes()


def base_spans(text: str, hexed: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexed:
        found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def file_class(text: str) -> int:
    n = max(1, len(text))
    if sum(map(text.count, "{};")) > 0.01 * n:
        return 0
    return 1 if sum(map(text.count, "0123456789")) > 0.05 * n else 2


class Tagger:
    """The field's weights, the margin that bounds its windows, and batched Viterbi."""

    def __init__(self, own, before, after, before2, files, moves):
        self.parts = [np.asarray(x, float) for x in (own, before, after, before2, files)]
        self.moves = np.array(moves, float)
        self.moves[O, I] = NEVER
        # Among plain words only, each B or I loses at least `margin`; the moves can win back `gain` once at most.
        o, b, f = self.parts[0], sum(p[PLAIN] for p in self.parts[1:4]), self.parts[4]
        plain = o[PLAIN] + b + f
        margin = float((plain[:, O, None] - plain[:, 1:]).min())
        usable = self.moves[self.moves > NEVER / 2]
        inside = max(self.moves[I, I], self.moves[B, I]) - self.moves[O, O]
        step = margin - max(0.0, inside)
        self.radius = 3 + int(np.ceil((usable.max() - usable.min()) * 2 / step)) if step > 0 else None

    def scores(self, c: np.ndarray, f: np.ndarray) -> np.ndarray:
        """[window, word, tag] for classes with two words of context at the left and one at the right."""
        own, before, after, before2, files = self.parts
        return own[c[:, 2:-1]] + before[c[:, 1:-2]] + after[c[:, 3:]] + before2[c[:, :-3]] + files[f][:, None]

    def viterbi(self, c: np.ndarray, f: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        s = self.scores(c, f)
        n, t, _ = s.shape
        s[np.arange(t)[None, :] >= sizes[:, None]] = (0.0, NEVER, NEVER)
        best = s[:, 0] + self.moves[O]
        back = np.zeros((n, t, 3), np.int8)
        for k in range(1, t):
            way = best[:, :, None] + self.moves[None]
            back[:, k] = way.argmax(1)
            best = way.max(1) + s[:, k]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = (best + self.moves[:, O]).argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = np.take_along_axis(back[:, k], tags[:, k, None].astype(int), 1)[:, 0]
        return tags


def windows(classes: np.ndarray, radius: int | None) -> list[tuple[int, int]]:
    """Ranges of words about those of a conspicuous shape, joined where they touch; without a radius the whole text."""
    at = np.flatnonzero(classes)
    if not len(at):
        return []
    if radius is None:
        return [(0, len(classes))]
    cut = np.flatnonzero(np.diff(at) > 2 * radius + 1) + 1
    return [(max(0, g[0] - radius), min(len(classes), g[-1] + radius + 1)) for g in np.split(at, cut)]


def padded(classes: np.ndarray) -> np.ndarray:
    return np.concatenate([[OUT, OUT], classes, [OUT]])


def predict(tagger: Tagger, docs: list[tuple[np.ndarray, int]]) -> dict[int, list[tuple[int, int]]]:
    """Document number -> tagged ranges of words. Windows of like length are decoded together."""
    jobs = sorted((b - a, k, a) for k, (c, _) in enumerate(docs) for a, b in windows(c, tagger.radius))
    found: dict[int, list[tuple[int, int]]] = {}
    k = 0
    while k < len(jobs):
        some = jobs[k : k + max(1, min(2000, 200_000 // jobs[min(len(jobs) - 1, k + 50)][0]))]
        k += len(some)
        t = some[-1][0]
        c = np.full((len(some), t + 3), OUT)
        for row, (size, d, a) in enumerate(some):
            p = padded(docs[d][0])[a : a + size + 3]
            c[row, : len(p)] = p
        sizes = np.array([x[0] for x in some])
        tags = tagger.viterbi(c, np.array([docs[d][1] for _, d, _ in some]), sizes)
        for row in np.flatnonzero((tags != O).any(1)):
            size, d, a = some[row]
            begun = None
            for j, tag in enumerate([*tags[row, :size].tolist(), O]):
                if begun is not None and tag != I:
                    found.setdefault(d, []).append((a + begun, a + j))
                    begun = None
                if tag == B:
                    begun = j
    return found


def word_classes(text: str) -> tuple[list[str], np.ndarray, bool]:
    tokens = text.split()
    raw = np.fromiter(map(SHAPES.__getitem__, tokens), np.int8, len(tokens))
    return tokens, raw & 31, bool((raw & 32).any())


WORDS = re.compile(r"\S+")


def scan(text: str, ranges: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the field's: a tagged range from its first to its last word without quotes, where no base span is."""
    if not ranges:
        return base
    at = [m.span() for m in WORDS.finditer(text)]
    more = []
    for a, b in ranges:
        start, end = at[a][0], at[b - 1][1]
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        if start < end and not any(s < end and start < e for s, _, e in base):
            more.append((start, 3, end))
    return sorted(base + more)


def spoilt(c: list[int], f: int, y: list[int]) -> list[tuple[list[int], int, list[int]]]:
    """Copies of a window with its tagged runs changed: values of other shapes, cues lost, values that are none.

    c has two words of context at the left and one at the right of those that y tags. A run of a name, a sign and a value
    is copied with the sign a plain word and with no sign, for values of all shapes that the patterns take; the same with
    a plain word or a short number is no secret. A value of a telling shape stands alone as well."""
    out = []

    def add(a: int, b: int, words: list[int], tags: list[int]):
        out.append((c[: a + 2] + words + c[b + 2 :], f, y[:a] + tags + y[b:]))

    for a in [k for k, tag in enumerate(y) if tag == B]:
        b = a + 1
        while b < len(y) and y[b] == I:
            b += 1
        name, value = c[a + 2], c[b + 1]
        if b - a > 1 and name == NAME and value not in (PLAIN, NAME, SIGN, JOINED):
            for shape_ in dict.fromkeys((value, MIXED, *TELLING, HEX8, UPPER)):
                add(a, b, [NAME, SIGN, shape_], [B, I, I])
                add(a, b, [NAME, PLAIN, shape_], [B, I, I])
                add(a, b, [NAME, shape_], [B, I])
            for dull in (PLAIN, DIGITS4):
                add(a, b, [NAME, PLAIN, dull], [O, O, O])
                add(a, b, [NAME, dull], [O, O])
        if value in TELLING:
            for shape_ in TELLING:
                add(a, b, [shape_], [B])
                add(a, b, [PLAIN, shape_], [O, B])
    return out


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, most_windows: int = 20_000, rounds: int = 150) -> Tagger:
    """Train on the `sample` documents that come first by a hash of their id (a bound, the same at every size).

    Their windows, made on the executors to classes and tags of 24 words at most, are counted by Spark; the driver gets
    the different ones, at most most_windows by a hash of theirs."""
    ids = docs.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
    schema = pa.schema([("c", pa.list_(pa.int8())), ("f", pa.int8()), ("y", pa.list_(pa.int8()))])

    def examples(batches):
        for b in batches:
            out = []
            for text in b.columns[0].to_pylist():
                _, classes, hexed = word_classes(text or "")
                at = [m.span() for m in WORDS.finditer(text or "")]
                tags = np.zeros(len(at), np.int8)
                covered = 0
                for start, _, end in base_spans(text or "", hexed):
                    first = max(0, bisect.bisect_right(at, (start, len(text))) - 1)
                    last = bisect.bisect_left(at, (end, 0))
                    tags[max(first, covered) : last] = I  # spans that overlap are one run
                    if first >= covered and first < last:
                        tags[first] = B
                    covered = max(covered, last)
                p = padded(classes)
                wide = [*windows(classes, 6), *([(0, min(8, len(at)))] if len(at) else [])]
                for a, z in ((k, min(z, k + 24)) for a, z in wide for k in range(a, z, 24)):
                    if any(classes[k] in TELLING and tags[k] == O for k in range(a, z)):
                        continue  # a word that could be one, of which nothing is known
                    row = (p[a : z + 3].tolist(), file_class(text), tags[a:z].tolist())
                    out += [row, *spoilt(*row)]
            yield pa.record_batch([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = (
        docs.join(F.broadcast(ids), id_col, "left_semi").select(text_col).mapInArrow(examples, "c array<tinyint>, f tinyint, y array<tinyint>")
        .groupBy("c", "f", "y").agg(F.count("*").alias("n")).orderBy(F.xxhash64("c", "f", "y"), "c", "f", "y").limit(most_windows).collect()
    )
    return train([(list(r.c), r.f, list(r.y), r.n) for r in rows], rounds)


def train(rows: list[tuple], rounds: int = 150, ridge: float = 1e-3) -> Tagger:
    """Maximum conditional likelihood by Adam; gradients from forward-backward over all windows at once.

    rows: classes, file class, tags, and how often the window occurs (once, if that is left out)."""
    if not any(any(r[2]) for r in rows):
        own = np.zeros((18, 3))
        own[:, 1:] = -9
        return Tagger(own, *(np.zeros((18, 3)) for _ in range(3)), np.zeros((FILES, 3)), np.zeros((3, 3)))
    rows = sorted(rows, key=repr)
    n, t = len(rows), max(len(r[2]) for r in rows)
    c, y, size = np.full((n, t + 3), OUT), np.zeros((n, t), int), np.array([len(r[2]) for r in rows])
    for k, r in enumerate(rows):
        c[k, : len(r[0])], y[k, : len(r[2])] = r[0], r[2]
    often = np.array([r[3] if len(r) > 3 else 1 for r in rows], float)
    whole = often.sum()
    f = np.array([r[1] for r in rows])
    live = np.arange(t)[None, :] < size[:, None]
    views = [c[:, 2:-1], c[:, 1:-2], c[:, 3:], c[:, :-3]]
    w = [np.zeros((18, 3)) for _ in range(4)] + [np.zeros((FILES, 3)), np.zeros((3, 3))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, rounds + 1):
        s = sum(w[k][views[k]] for k in range(4)) + w[4][f][:, None]
        s[~live] = (0.0, NEVER, NEVER)
        moves = w[5].copy()
        moves[O, I] = NEVER
        alpha, beta = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        alpha[:, 0] = s[:, 0] + moves[O]
        for k in range(1, t):
            alpha[:, k] = np.logaddexp.reduce(alpha[:, k - 1, :, None] + moves[None], axis=1) + s[:, k]
        beta[:, -1] = moves[:, O]
        for k in range(t - 2, -1, -1):
            beta[:, k] = np.logaddexp.reduce(moves[None] + (s[:, k + 1] + beta[:, k + 1])[:, None], axis=2)
        z = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
        p = np.exp(alpha + beta - z[:, None, None])
        delta = (np.eye(3)[y] - p) * live[:, :, None] * often[:, None, None]
        grads = []
        for k in range(4):
            g = np.zeros((18, 3))
            np.add.at(g, views[k].ravel(), delta.reshape(-1, 3))
            grads.append(g)
        g = np.zeros((FILES, 3))
        np.add.at(g, f, delta.sum(1))
        grads.append(g)
        g = np.zeros((3, 3))
        for k in range(1, t):
            on = live[:, k]
            pair = np.exp(alpha[on, k - 1, :, None] + moves[None] + (s[on, k] + beta[on, k])[:, None] - z[on, None, None])
            g -= (pair * often[on, None, None]).sum(0)
            np.add.at(g, (y[on, k - 1], y[on, k]), often[on])
        grads.append(g)
        for k in range(6):
            d = grads[k] / whole - ridge * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] + 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Tagger(*w)


def find_secrets(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans. A map; the tagger is a few KB."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def found(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                texts = [t or "" for t in b.columns[1][k : k + 500].to_pylist()]
                docs, bases = [], []
                for t in texts:
                    _, classes, hexed = word_classes(t)
                    docs.append((classes, file_class(t) if classes.any() else 2))
                    bases.append(base_spans(t, hexed))
                tagged = predict(tagger, docs)
                rows = []
                for d, (t, base) in enumerate(zip(texts, bases)):
                    spans = scan(t, tagged.get(d, []), base)
                    say = lambda some: ",".join(f"{KINDS[q]}:{a}:{z}" for a, q, z in some)
                    count = [sum(q == kind for _, q, _ in spans) for kind in range(4)]
                    rows.append((*count[:3], hashlib.sha256(say(base).encode()).hexdigest(), say(spans), count[3]))
                yield pa.record_batch([b.columns[0][k : k + 500], *(pa.array(c, f) for c, f in zip(zip(*rows), types[1:]))], schema=schema)

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(found, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, fit_tagger(docs))
