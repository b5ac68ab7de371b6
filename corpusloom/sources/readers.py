"""File readers: decoded text of many formats as rows (path, page_number, text).

Files are read with Spark's binaryFile source and parsed in Arrow batches by a function of the extension; parsers are
plain functions of bytes, so they can be tested alone. Formats whose decoders are not at hand (PDF, office, audio) are
taken as text that was decoded elsewhere."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Limits of a container: members, bytes unpacked, and times its packed size.
MEMBERS, UNPACKED, RATIO = 5_000, 512 << 20, 200


def decode(raw: bytes) -> str:
    """Byte order mark, UTF-16 by its zero bytes, UTF-8, Windows-1252, Latin-1; the first that fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    head = raw[:4096]
    if len(head) >= 8 and head.count(0) > len(head) // 4:
        return raw.decode("utf-16-le" if head[1::2].count(0) > head[::2].count(0) else "utf-16-be", "replace")
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def paginate(text: str, per_page: int) -> list[str]:
    """Pages of a number of lines; blank ones are left out."""
    lines = text.split("\n")
    pages = ["\n".join(lines[k : k + per_page]) for k in range(0, len(lines), per_page)]
    return [p for p in pages if p.strip()]


def grouped(parts: list[str], n: int, sep: str = "\n") -> list[str]:
    return [sep.join(parts[k : k + n]) for k in range(0, len(parts), n)]


def delimiter(sample: str, preferred: str = ",") -> str:
    """The separator whose field counts agree most; ties by more fields, then by the preferred one."""
    lines = [x for x in sample.splitlines() if x.strip()][:50]
    best, found = (0.0, 0, False), preferred
    for d in ",;\t|":
        counts = [len(r) for r in csv.reader(lines, delimiter=d)] or [1]
        mode = max(set(counts), key=counts.count)
        if mode > 1:
            score = (counts.count(mode) / len(counts), mode, d == preferred)
            if score > best:
                best, found = score, d
    return found


def _numeric(cell: str) -> bool:
    return bool(re.fullmatch(r"[($€£-]*[\d,]*\.?\d+[)%]*", cell.strip()) or re.fullmatch(r"\d{1,4}[/-]\d{1,2}[/-]\d{1,4}", cell.strip()))


def header_row(rows: list[list[str]], most: int = 30) -> int:
    """The first row that looks like a header and has data under it, else 0."""
    for k, row in enumerate(rows[:most]):
        cells = [c for c in row if c.strip()]
        named = len(cells) >= 3 and len(cells) >= 0.5 * len(row) and sum(not _numeric(c) and len(c) <= 60 for c in cells) >= 0.8 * len(cells)
        below = next((r for r in rows[k + 1 : k + 4] if any(c.strip() for c in r)), [])
        if named and below and sum(_numeric(c) for c in below if c.strip()) >= 0.4 * max(1, sum(bool(c.strip()) for c in below)):
            return k
    return 0


def preamble(rows: list[list[str]]) -> dict[str, str]:
    """Key and value pairs above the header: two cells, or `Key: value`."""
    out = {}
    for row in rows:
        cells = [c.strip() for c in row if c.strip()]
        if len(cells) == 2:
            out[cells[0].rstrip(":")] = cells[1]
        elif len(cells) == 1 and (m := re.match(r"([^:]{1,60}):\s*(.+)", cells[0])):
            out[m[1]] = m[2]
    return out


def table_rows(raw: bytes, preferred: str = ",") -> tuple[list[str], list[list[str]], dict[str, str]]:
    """(columns, rows, metadata) of a delimited file; repeated header rows are left out."""
    text = decode(raw)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter(text[: 64 << 10], preferred)) if any(c.strip() for c in r)]
    if not rows:
        return [], [], {}
    at = header_row(rows)
    names = [c.strip() or f"column_{k}" for k, c in enumerate(rows[at], 1)]
    low = {n.lower() for n in names}

    def repeats(row: list[str]) -> bool:
        cells = [c.strip().lower() for c in row if c.strip()]
        return len(cells) >= 3 and sum(c in low for c in cells) >= 0.6 * len(cells)

    return names, [(r + [""] * len(names))[: len(names)] for r in rows[at + 1 :] if not repeats(r)], preamble(rows[:at])


def csv_pages(raw: bytes) -> list[str]:
    names, rows, _ = table_rows(raw)
    lines = [" | ".join(r) for r in rows]
    pages = grouped(lines, 50)
    return [" | ".join(names) + "\n" + pages[0], *pages[1:]] if pages else []


def lenient_json(text: str):
    """JSON with comments and trailing commas; several documents become a list."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    string = r'"(?:\\.|[^"\\])*"'
    bare = re.sub(rf"({string})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    bare = re.sub(rf"({string})|,(?=\s*[\]}}])", lambda m: m[1] or "", bare)
    decoder, out, at = json.JSONDecoder(), [], 0
    while at < len(bare):
        if bare[at].isspace() or bare[at] == ",":
            at += 1
            continue
        value, at = decoder.raw_decode(bare, at)
        out.append(value)
    return out[0] if len(out) == 1 else out


def json_pages(raw: bytes) -> list[str]:
    """A page per key of an object, ten items of an array to a page, or the scalar."""
    data = lenient_json(decode(raw))
    show = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    if isinstance(data, dict):
        return [f"{k}: {show(v)}" for k, v in data.items()]
    return grouped([show(x) for x in data], 10) if isinstance(data, list) else [show(data)]


def jsonl_pages(raw: bytes) -> list[str]:
    """Ten lines to a page; a line that does not parse is kept as text."""
    out = []
    for line in decode(raw).splitlines():
        if line.strip():
            try:
                out.append(json.dumps(json.loads(line), ensure_ascii=False))
            except ValueError:
                out.append(line.strip())
    return grouped(out, 10)


def flatten(value, path: str = "", depth: int = 12) -> list[tuple[str, str]]:
    """(path, text) of every leaf; lists of scalars are joined."""
    if isinstance(value, dict) and depth:
        return [x for k, v in value.items() for x in flatten(v, f"{path}.{k}" if path else str(k), depth - 1)]
    if isinstance(value, list) and depth:
        if all(not isinstance(v, (dict, list)) for v in value):
            return [(path, ", ".join("" if v is None else str(v) for v in value))]
        return [x for k, v in enumerate(value) for x in flatten(v, f"{path}[{k}]", depth - 1)]
    return [(path, "" if value is None else str(value))]


def dominant_list(data, depth: int = 3) -> list[dict] | None:
    """The largest list of two objects or more within three levels."""
    best: list[dict] | None = None
    stack = [(data, 0)]
    while stack:
        x, d = stack.pop()
        if isinstance(x, list) and len(x) >= 2 and all(isinstance(v, dict) for v in x) and (best is None or len(x) > len(best)):
            best = x
        if d < depth:
            stack += [(v, d + 1) for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return best


def markdown_pages(raw: bytes) -> list[str]:
    return [s for s in re.split(r"(?m)(?=^#{1,2}\s+)", decode(raw)) if s.strip()]


CHROME = re.compile(r"\b(nav|menu|footer|header|sidebar|breadcrumb|cookie|banner|advert|ad|ads|social|share)\b", re.I)


class _Html(HTMLParser):
    """Text blocks with the headings that part them, in and out of navigation."""

    SKIP, BLOCK = {"script", "style", "noscript", "template"}, {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "section", "article", "table", "ul", "title", "body", "main"}
    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.text: list[str] = []
        self.title = ""

    def _flush(self, tag: str = "p") -> None:
        text = re.sub(r"[ \t\r\n]+", " ", "".join(self.text)).strip(" |")
        self.text = []
        if not text:
            return
        tags = [t for t, _, _ in self.stack]
        if "title" in tags or tag == "title":
            self.title = self.title or text
            return
        self.blocks.append((tag, text, any(c for _, c, _ in self.stack), any(m for _, _, m in self.stack)))

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self._flush()
        if tag in self.VOID:
            return
        a = dict(attrs)
        chrome = tag in ("nav", "footer", "aside", "form") or a.get("role") in ("navigation", "banner", "contentinfo", "search") or bool(CHROME.search(f"{a.get('class') or ''} {a.get('id') or ''}"))
        self.stack.append((tag, chrome, tag in ("main", "article")))

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.text.append(" | ")
        if tag in self.BLOCK:
            self._flush(tag)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not any(t in self.SKIP for t, _, _ in self.stack):
            self.text.append(data)


def html_sections(raw: bytes | str, name: str = "") -> list[str]:
    """Sections parted at h1 and h2, without navigation unless that is most of the page; the title comes first."""
    p = _Html()
    p.feed(raw if isinstance(raw, str) else decode(raw))
    p.close()
    p._flush()
    size = lambda bs: sum(len(b[1]) for b in bs)
    blocks = p.blocks
    main = [b for b in blocks if b[3]]
    if main and size(main) >= 0.4 * size(blocks):
        blocks = main
    body = [b for b in blocks if not b[2]]
    if size(body) >= 0.4 * size(blocks):
        blocks = body
    sections: list[list[str]] = [[]]
    for tag, text, _, _ in blocks:
        if tag in ("h1", "h2") and sections[-1]:
            sections.append([])
        sections[-1].append(text)
    out = ["\n".join(s) for s in sections if s]
    title = p.title or name
    return ([f"{title}\n{out[0]}" if title and not out[0].startswith(title) else out[0], *out[1:]] if out else [title] if title else [])


def subtitle_pages(raw: bytes) -> list[str]:
    """Cues without numbers, times and markup; equal neighbours once; 100 to a page."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", decode(raw).replace("\r\n", "\n")):
        lines = [x for x in block.split("\n") if x.strip() and "-->" not in x and not x.strip().isdigit() and not x.startswith(("WEBVTT", "NOTE", "STYLE"))]
        text = re.sub(r"<[^>]+>|\{[^}]+\}", "", " ".join(lines)).strip()
        if text and (not out or out[-1] != text):
            out.append(text)
    return grouped(out, 100)


def rtf_text(source: str) -> str:
    """Control words dropped, paragraphs and escapes kept, destinations such as font tables left out."""
    out, stack, skip, at = [], [], False, 0
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
    while at < len(source):
        m = token.match(source, at)
        if not m:
            at += 1
            continue
        at = m.end()
        word, number, hexed, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif hexed:
            out.append(bytes([int(hexed, 16)]).decode("cp1252", "replace"))
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif plain:
            out.append(plain)
    return "".join(out).strip()


def check_container(raw: bytes) -> zipfile.ZipFile:
    """Open a zip container if its members, size and ratio are within limits."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    total = sum(i.file_size for i in z.infolist())
    if len(z.infolist()) > MEMBERS or total > UNPACKED or total > RATIO * max(1, len(raw)):
        raise ValueError("the container unpacks beyond its limits")
    return z


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _inline(node) -> str:
    out = node.text or ""
    for child in node:
        out += {"tab": "\t", "line-break": "\n", "s": " "}.get(_local(child.tag), "") + _inline(child) + (child.tail or "")
    return out


def opendocument_pages(raw: bytes, kind: str) -> list[str]:
    """Text in tens of blocks, sheets as rows of cells, slides one by one."""
    root = ElementTree.fromstring(check_container(raw).read("content.xml"))
    if kind == "odt":
        return grouped([t for e in root.iter() if _local(e.tag) in ("p", "h") and (t := _inline(e).strip())], 10)
    if kind == "odp":
        return [p for e in root.iter() if _local(e.tag) == "page" and (p := "\n".join(t for x in e.iter() if _local(x.tag) == "p" and (t := _inline(x).strip())))]
    pages = []
    for sheet in (e for e in root.iter() if _local(e.tag) == "table"):
        rows = [" | ".join(" ".join(_inline(p) for p in c if _local(p.tag) == "p") for c in r if _local(c.tag) == "table-cell") for r in sheet.iter() if _local(r.tag) == "table-row"]
        pages += grouped([r for r in rows if r.strip(" |")], 50)
    return pages


def epub_pages(raw: bytes) -> list[str]:
    z = check_container(raw)
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
    book, base = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
    items = {e.attrib["id"]: e.attrib["href"] for e in book.iter() if _local(e.tag) == "item"}
    order = [items[e.attrib["idref"]] for e in book.iter() if _local(e.tag) == "itemref" and e.attrib["idref"] in items]
    return [s for href in order for s in html_sections(z.read(f"{base}/{href}" if base else href))]


def svg_pages(raw: bytes) -> list[str]:
    text = "\n".join(t for e in ElementTree.fromstring(raw).iter() if _local(e.tag) in ("text", "title", "desc") and (t := _inline(e).strip()))
    return [text] if text else []


def mail_text(raw: bytes) -> str:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = "\n".join(f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if m[k])
    body = m.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body else ""
    if body is not None and body.get_content_subtype() == "html":
        text = "\n".join(html_sections(text))
    return f"{head}\n\n{text.strip()}"


def mbox_pages(raw: bytes, most: int = 5000) -> list[str]:
    parts = re.split(rb"(?m)^From [^\n]*\n", raw)
    return [mail_text(p) for p in parts if p.strip()][:most]


def notebook_pages(raw: bytes, per_page: int = 20, clip: int = 2000) -> list[str]:
    out = []
    for cell in json.loads(decode(raw)).get("cells", []):
        text = "".join(cell.get("source", []))
        for o in cell.get("outputs", []):
            text += "\n" + "".join(o.get("text", o.get("data", {}).get("text/plain", [])))[:clip]
        if text.strip():
            out.append(text)
    return grouped(out, per_page, "\n\n")


SYMBOL = {
    "py": re.compile(r"(?m)^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)"),
    "js": re.compile(r"(?m)^([ \t]*)(?:export\s+)?(?:async\s+)?(function|class)\s+(\w+)"),
    "java": re.compile(r"(?m)^([ \t]*)(?:public|private|protected)?\s*(?:static\s+)?(class|interface|enum)\s+(\w+)"),
    "go": re.compile(r"(?m)^()(func|type)\s+(?:\([^)]*\)\s*)?(\w+)"),
}


def symbols(source: str, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line): a symbol ends before the next line that is not deeper."""
    pattern, lines, out = SYMBOL.get(language), source.split("\n"), []
    for m in pattern.finditer(source) if pattern else ():
        first = source.count("\n", 0, m.start(2)) + 1
        indent, last = len(m[1]), first
        for k in range(first, len(lines)):
            text = lines[k]
            if text.strip() and len(text) - len(text.lstrip()) <= indent and not text.strip().startswith(("}", ")", "]")):
                break
            if text.strip():
                last = k + 1
        out.append((m[2], m[3], first, last))
    return out


def code_pages(raw: bytes, language: str, size: int = 2000) -> list[str]:
    """Top symbols as chunks, larger ones and the lines between them packed to a size."""
    text = decode(raw)
    lines, out, at = text.split("\n"), [], 0
    spans, end = [], 0
    for _, _, a, b in symbols(text, language):
        if a > end:
            spans.append((a - 1, b))
            end = b
    for a, b in [*spans, (len(lines), len(lines))]:
        for x, y in ((at, a), (a, b)):
            part: list[str] = []
            for line in lines[x:y]:
                if part and sum(map(len, part)) + len(line) > size:
                    out.append("\n".join(part))
                    part = []
                part.append(line)
            out.append("\n".join(part))
        at = b
    return [p for p in out if p.strip()]


READERS: dict[str, Callable[[bytes], list[str]]] = {
    "txt": lambda b: paginate(decode(b), 100), "log": lambda b: paginate(decode(b), 100), "md": markdown_pages, "csv": csv_pages, "tsv": csv_pages, "json": json_pages, "jsonl": jsonl_pages,
    "html": html_sections, "htm": html_sections, "srt": subtitle_pages, "vtt": subtitle_pages, "rtf": lambda b: paginate(rtf_text(decode(b)), 100), "odt": lambda b: opendocument_pages(b, "odt"),
    "ods": lambda b: opendocument_pages(b, "ods"), "odp": lambda b: opendocument_pages(b, "odp"), "epub": epub_pages, "svg": svg_pages, "eml": lambda b: [mail_text(b)], "mbox": mbox_pages, "ipynb": notebook_pages,
    **{x: (lambda b, x=x: code_pages(b, x)) for x in SYMBOL},
}


def read_pages(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, page_number, text, error): the pages of every file, one task reading many; a file that fails gives its error."""
    schema = pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                reader = READERS.get(name.rpartition(".")[2].lower(), READERS["txt"])
                try:
                    rows = [(name, k, t, None) for k, t in enumerate(reader(content.as_py()), 1)]
                except Exception as e:  # one bad file must not end the job; its error is a row
                    rows = [(name, 0, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parsed, "path string, page_number int, text string, error string")
