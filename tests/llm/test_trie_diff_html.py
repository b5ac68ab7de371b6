"""The prefix trie, the snapshot difference and the extraction of main texts against plain versions."""

import collections
import hashlib
import re
import zlib
from html import unescape

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_extract, prefix_trie, ranks, snapshot_diff
from corpusloom.llm.common import Scratch
from corpusloom.llm.html_tree import parse
from corpusloom.llm.wrappers import align, dump, infer, load, show, slots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- ranks


def test_ranks_of_groups_that_spread_over_tasks(spark):
    rows = [(g, k) for g, n in (("a", 700), ("b", 1), ("c", 40), ("", 3)) for k in range(n)] + [("a", 5)] * 50
    df = spark.createDataFrame(rows, "g string, k bigint").repartition(7)
    got = ranks.ranked(Scratch(spark, "t"), "r", df, "g", [F.col("k").desc()], "i").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.g].append((r.i, r.k))
    for g, n in collections.Counter(g for g, _ in rows).items():
        assert [i for i, _ in sorted(by[g])] == list(range(1, n + 1))
        assert [k for _, k in sorted(by[g])] == sorted((k for x, k in rows if x == g), reverse=True)


# ---- op11


def trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [k[2:] for k in sorted(v)] for c, v in own.items()}
    nodes, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
        ends[turns].append(c)
    name = {k: (v[0], len(k)) for k, v in nodes.items()}
    kids = collections.defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(nodes[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
    return sorted(
        (*name[k], name[k[:-1]][0] if k else -1, len(v), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, v in nodes.items()
    )


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def run_trie(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS).withColumn("c", F.lit("x")).withColumn("depth", F.lit(1)))
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect())


def test_trie_equals_brute_force(spark):
    rows = []
    for c in [*range(0, 45), *range(100, 112)]:
        for t in range(zlib.crc32(b"n%d" % c) % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {zlib.crc32(b'%d' % c) % 3} words"))
    rows += [(46, None, None, None), (46, None, None, None), (46, 3, "user", ""), (47, 1, "a", "same"), (47, 1, "a", "same"), (47, 1, "a", "other"), (None, 0, "user", "nobody's")]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(6)]
    rows += [(300, t, "user", "long " * (1 + t % 5)) for t in range(90)] + [(301, 0, "user", "w " * 50_000)]
    assert run_trie(spark, rows) == trie(rows)


@pytest.mark.parametrize("rows", [[(5, 0, "user", "a b")], [(7, 0, None, None), (7, 0, None, None)], [(20, 0, "u", "x"), (21, 0, "u", "x"), (22, 0, "u", "x")]])
def test_small_tries(spark, rows):
    assert run_trie(spark, rows) == trie(rows)


def test_trie_of_no_conversations(spark):
    assert run_trie(spark, []) == []
    assert run_trie(spark, [(None, 1, "user", "x")]) == []


def test_digest_of_many_ends(spark):
    """Pieces of ids, in order, have the digest of the whole, also where a node's ids stand in several pieces."""
    ids = list(range(-20, 30_000))
    df = spark.createDataFrame([(2, 7, c) for c in ids] + [(2, 8, 1), (3, 7, 5)], "depth bigint, conv_id bigint, c bigint").repartition(5)
    got = {(r.depth, r.conv_id): r.ends_sha256 for r in prefix_trie.digests(df).collect()}
    assert got == {(2, 7): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (2, 8): hashlib.sha256(b"1").hexdigest(), (3, 7): hashlib.sha256(b"5").hexdigest()}


# ---- op12

ROWS = "k bigint, a string, b string"


def plain_diff(old, new):
    """Brute force over lists of (key, a, b)."""
    low = lambda x: tuple((v is not None, v if v is not None else "") for v in x)
    keys = lambda k: (k is not None, k or 0)
    out, left, right = [], [], []
    for k in {r[0] for r in old} | {r[0] for r in new}:
        a, b = (sorted((r[1:] for r in rows if r[0] == k), key=low) for rows in (old, new))
        for x, y in zip(a, b):
            names = ",".join(n for n, p, q in zip("ab", x, y) if p != q)
            out.append((k, k, "update" if names else "same", names))
        left += [(k, x) for x in a[len(b) :]]
        right += [(k, x) for x in b[len(a) :]]
    for content in {x for _, x in left} | {x for _, x in right}:
        a = sorted((k for k, x in left if x == content), key=keys)
        b = sorted((k for k, x in right if x == content), key=keys, reverse=True)
        out += [(q, p, "rekey", "") for p, q in zip(a, b)]
        out += [(k, k, "delete", "") for k in a[len(b) :]] + [(k, None, "insert", "") for k in b[len(a) :]]
    return sorted(out, key=str)


@pytest.mark.parametrize("case", range(5))
def test_diff_equals_brute_force(spark, case):
    pick = lambda s, n: zlib.crc32(f"{case} {s}".encode()) % n
    value = lambda s: [None, "", "x", "y", "x" * 3000][pick(s, 5)]
    old = [(k, value(f"a{k}"), value(f"b{k}")) for k in range(120)]
    new = [(k if pick(f"k{k}", 3) else -1 - k, value(f"a{k}") if pick(f"c{k}", 4) else "new", value(f"b{k}")) for k in range(20, 150)]
    if case == 1:  # repeated keys, null keys and repeated rows
        old += [(3, "x", "y")] * 3 + [(None, None, None)] * 2 + [(None, "x", "")]
        new += [(3, "x", "y")] + [(None, None, None), (None, "q", None)] + [(-500, "x", "y")] * 2
    if case == 2:  # one content for all
        old, new = [(k, None, "same") for k in range(300)], [(k, None, "same") for k in range(200, 700)]
    if case == 3:
        old = []
    if case == 4:
        new = []
    a, b = (spark.createDataFrame(x, ROWS).withColumns({"_n": F.lit(1), "_side": F.lit("z"), "key": F.lit(0), "op": F.lit("")}) for x in (old, new))
    got = snapshot_diff.snapshot_diff(a, b, "k", ["a", "b"], ("a",)).collect()
    assert sorted(((r["key"], r.old_key, r.op, r.changed) for r in got), key=str) == plain_diff(old, new)
    texts = {k: {x for key, x, _ in new if key == k} for k in {r[0] for r in new}}
    assert all((r.a in texts[r["key"]]) if r.op != "delete" else r.a is None for r in got)


def test_diff_of_two_empty_snapshots(spark):
    empty = spark.createDataFrame([], ROWS)
    assert snapshot_diff.snapshot_diff(empty, empty, "k", ["a", "b"]).collect() == []


def test_later_snapshot(spark):
    docs = [(k, None if k % 9 == 0 else f"t{k}", "en", f"s{k % 3}") for k in range(300)] + [(None, "t", "en", None)]
    want = []
    for k, text, lang, source in docs:
        kind = zlib.crc32(str(k).encode()) % 10 if k is not None else 9
        if kind == 0:
            continue
        if kind == 1:
            text = (text or "") + "+"
        if kind == 2:
            lang, source = source, lang
        want.append((-1 - k if kind in (3, 4) else k, text, lang, None if kind == 4 else source))
        if kind == 5:
            want.append((-1 - k, text, lang, source))
    got = [tuple(r) for r in snapshot_diff.later(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---- op13


def extracted(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"host": F.lit("h"), "texts": F.lit(1), "id": F.lit("i")})
    return {r.page_id: r.text for r in html_extract.main_texts(df).collect()}


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = html_extract.main_texts(pages).collect()
    assert len(got) == len(html)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", ""))]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


CASES = {
    "chrome inside an article": (
        "<article><header><p>By line</p><h1>Title &amp; more</h1></header><nav>menu</nav><p>One<br>two&nbsp;<b>three</b></p><aside>side</aside><form><input><button>Go</button></form><div class='ad-box'>buy</div><section id='comments'><article class='comment'><p>me too</p></article></section><footer>foot</footer></article>",
        "Title & more\n\nOne two three",
    ),
    "main that holds more than its article": ("<main><p>Long text before the article</p><article><p>short</p></article></main><div>x</div>", "Long text before the article\n\nshort"),
    "named content": ("<div class='cookie-notice'>accept</div><div id='content'><p>a</p><ul><li>b</li><li>c</li></ul></div><div>rest</div>", "a\n\nb\n\nc"),
    "no region: lists of links go": ("<div><a href=x>one</a> <a href=y>two</a></div><h2>head</h2><p>text</p>", "head\n\ntext"),
    "unclosed elements": ("<body><nav><ul><li>a<li>b</ul></nav><article><p>x<p>y<ul><li>1<li>2</ul><table><tr><td>c<td>d</table>", "x\n\ny\n\n1\n\n2\n\nc\n\nd"),
    "markup in scripts and comments": ("<script>var t='</p><article>no</article>';</script><style>p{}</style><!-- <p>no</p> --><article>a < b &lt;p&gt; &#233;<p title='x > y'>z</p></article>", "a < b <p> é\n\nz"),
    "a word of chrome on what holds the article": ("<div class='has-sidebar header-fixed'><article class='post widget'><p>kept</p></article></div>", "kept"),
    "nothing": ("", ""), "null": (None, ""), "only chrome": ("<nav>a</nav><footer>b</footer>", ""), "broken tags": ("<article><p>a</p><p b='", "a\n\n<p b='"),
}


def test_cases_of_pages(spark):
    got = extracted(spark, [(k, f"http://h{k}.example/x", html) for k, (html, _) in enumerate(CASES.values())])
    assert {name: got[k] for k, name in enumerate(CASES)} == {name: text for name, (_, text) in CASES.items()}


def test_template_text_of_a_host_goes_and_other_text_stays(spark):
    """A text that all pages of a host have in the same place is template; the same on some, few or equal pages is text."""
    page = "<div class=x><article><h1>Same title</h1><div>Read more stories</div><p>Paragraph {}</p>{}</article></div>"
    many = [(k, "http://a.example/", page.format(k, "<h2>End</h2><p>Last</p>" if k % 2 else "")) for k in range(50)]
    few = [(100 + k, "http://b.example/", page.format(k, "")) for k in range(5)]
    copies = [(200 + k, "http://c.example/", page.format(0, "")) for k in range(40)]
    got = extracted(spark, many + few + copies + [(300, None, page.format(7, ""))])
    assert got[0] == "Same title\n\nParagraph 0" and got[1] == "Same title\n\nParagraph 1\n\nEnd\n\nLast"
    assert {got[k] for k, _, _ in few + copies} == {f"Same title\n\nRead more stories\n\nParagraph {k}" for k in range(5)}
    assert got[300] == "Same title\n\nRead more stories\n\nParagraph 7"


def test_many_shapes_of_one_host(spark, monkeypatch):
    """Expressions are aligned in rounds; pages keep their own texts whatever the rounds are."""
    pages = []
    for k in range(80):
        middle = "".join(f"<{t}>t{k}{t}</{t}>" for i, t in enumerate(["p", "h2", "blockquote", "pre", "h3", "address"]) if k >> i & 1 or i == k % 6)
        pages.append((k, "http://a.example/", f"<nav>m</nav><article>{middle}</article><footer>f</footer>"))
    whole = extracted(spark, pages)
    assert all(whole[k] == "\n\n".join(re.findall(r">([^<>]+)<", html.split("article>")[1])) for k, _, html in pages)
    monkeypatch.setattr(html_extract, "ALIGNED", 5)
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert extracted(spark, pages) == whole


def test_wrapper_of_a_host(spark):
    pages = [(1, "http://a.example/1", "<h1>t</h1><p>a</p><p>b</p><dl><dt>x<dd>y<dt>x<dd>y</dl>"), (2, "http://a.example/2", "<h1>t</h1><div>n</div><p>a</p><dl><dt>x<dd>y</dl>")]
    got = html_extract.host_wrappers(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert [(r.host, r.wrapper) for r in got] == [("a.example", "<body><h1>#</h1>(<div>#</div>)?(<p>#</p>)+<dl>(<dt>#</dt><dd>#</dd>)+</dl></body>")]


def test_expressions_round_trip_and_accept_each_other():
    a = infer(parse("<p>x</p><ul><li>a<li>b</ul><p>y</p><ul><li>c</ul>")[0])
    assert show(a) == "<body>(<p>#</p><ul>(<li>#</li>)+</ul>)+</body>" and dump(load(dump(a))) == dump(a)
    assert [s.ids for s in slots(a)] == [[0, 3], [1, 2, 4]]
    both = align(load(dump(a)).kids, infer(parse("<p>x</p><ul><li>a</ul>")[0]).kids)
    assert "".join(map(show, both)) == "(<p>#</p><ul>(<li>#</li>)+</ul>)+"


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "<p>core</p>" + "</div>" * 5000 + "<p>after</p>"
    long = "<article>" + "".join(f"<p>p{k}</p>" for k in range(60_000)) + "</article>"
    unclosed = "<article><p>a</p>" + "<a title=\"" * 3000
    got = extracted(spark, [(1, "http://d.example", deep), (2, "http://e.example", long), (3, "http://f.example", unclosed)])
    assert got[1] == "core\n\nafter" and got[2] == "\n\n".join(f"p{k}" for k in range(60_000)) and got[3].startswith("a\n\n")


def test_no_pages(spark):
    assert extracted(spark, []) == {}
