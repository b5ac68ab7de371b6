"""Readers of bytes, and the source that applies them to files."""

import io
import json
import zipfile

from corpusloom.sources import readers as R


def test_decode():
    assert R.decode("né".encode("utf-8-sig")) == "né"
    assert R.decode("né".encode("utf-16")) == "né"
    assert R.decode("plain text".encode("utf-16-le")) == "plain text"
    assert R.decode(b"caf\xe9") == "café"
    assert R.decode(b"") == ""


def test_delimited_table():
    raw = b"Report: March\nOwner;Ann\nName;Amount;Day\nA;1,5;2026-01-02\nB;2;2026-01-03\nName;Amount;Day\nC;3;2026-01-04\n"
    names, rows, meta = R.table_rows(raw)
    assert names == ["Name", "Amount", "Day"]
    assert [r[0] for r in rows] == ["A", "B", "C"]
    assert meta == {"Report": "March", "Owner": "Ann"}
    assert R.table_rows(b"") == ([], [], {})


def test_json_forms():
    assert R.lenient_json('{"a": 1, // note\n "b": [1, 2,],}') == {"a": 1, "b": [1, 2]}
    assert R.lenient_json('{"u": "http://x"} {"u": 2}') == [{"u": "http://x"}, {"u": 2}]
    assert len(R.json_pages(json.dumps(list(range(25))).encode())) == 3
    assert R.jsonl_pages(b'{"a":1}\nnot json\n') == ['{"a": 1}\nnot json']
    assert R.flatten({"a": [{"b": [1, 2]}, {"b": None}]}) == [("a[0].b", "1, 2"), ("a[1].b", "")]
    assert R.dominant_list({"x": {"rows": [{"a": 1}, {"a": 2}]}, "y": [{"a": 1}]}) == [{"a": 1}, {"a": 2}]


def test_markup():
    html = "<html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav><main><h1>One</h1><p>a &amp; b</p><h2>Two</h2><table><tr><td>x</td><td>y</td></tr></table></main><footer>f</footer></body></html>"
    assert R.html_sections(html) == ["T\nOne\na & b", "Two\nx | y"]
    assert R.markdown_pages(b"# A\nx\n## B\ny\n### C\n") == ["# A\nx\n", "## B\ny\n### C\n"]
    assert R.rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par W\'f6rld \{x\}}") == "Hello\nWörld {x}"
    assert R.subtitle_pages(b"1\n00:00:01 --> 00:00:02\n<i>Hi</i>\n\n2\n00:00:02 --> 00:00:03\nHi\n") == ["Hi"]
    assert R.svg_pages(b"<svg xmlns='http://www.w3.org/2000/svg'><text>a<tspan>b</tspan></text></svg>") == ["ab"]


def test_containers_and_mail():
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("content.xml", "<o xmlns:t='u'><t:p>one</t:p><t:p>two</t:p></o>")
    assert R.opendocument_pages(box.getvalue(), "odt") == ["one\ntwo"]
    assert R.mail_text(b"From: a@x\nSubject: S\n\nbody\n") == "From: a@x\nSubject: S\n\nbody"
    assert len(R.mbox_pages(b"From a\nSubject: 1\n\nx\nFrom b\nSubject: 2\n\ny\n")) == 2
    assert R.notebook_pages(json.dumps({"cells": [{"source": ["a"]}, {"source": ["b"], "outputs": [{"text": ["o"]}]}]}).encode()) == ["a\n\nb\no"]


def test_code():
    source = "import x\n\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        pass\n"
    assert [(k, n, a, b) for k, n, a, b in R.symbols(source, "py")] == [("def", "f", 3, 4), ("class", "A", 6, 8), ("def", "g", 7, 8)]
    assert R.code_pages(source.encode(), "py")[1].startswith("def f")


def test_read_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx\n# B\ny\n")
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("")
    rows = {(r.path.rpartition("/")[2], r.page_number): r for r in R.read_pages(spark, str(tmp_path)).collect()}
    assert rows["a.md", 2].text == "# B\ny\n"
    assert rows["b.json", 0].error
    assert ("c.txt", 1) not in rows
