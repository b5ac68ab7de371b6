"""HTML to a tree of blocks: a lenient tokenizer, implied end tags, and text blocks with decoded references."""

from __future__ import annotations

import re
from html import unescape

#: Elements by the HTML standard, and words of class, id and role attributes by their common use.
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul button select label".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
KEEPS_P = frozenset("button label select option optgroup".split())
CHROME_TAGS = frozenset("nav aside footer form dialog menu search button select label option optgroup fieldset legend".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside complementary contentinfo widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alertdialog dialog popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending comment comments disqus respond reply replies toolbar pagination pager search form".split()
)
MAIN_WORDS = frozenset("main article content post entry story".split())
KNOWN = CHROME_WORDS | MAIN_WORDS
#: Blocks nested deeper than this lie flat in the tree; their text stays.
DEPTH = 100

_ATTR = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*|(?=>)))?"""
TOKEN = re.compile(rf"<!--(?:.*?-->|-?>)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]+|{_ATTR})*+)>|<[!?/][^>]*>", re.S)
MARKS = re.compile(r"""(?:^|[\s/])(class|id|role|hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Item:
    """A node of a tree or expression. sig: the element with the known words of its attributes, `#` for text, `(` for a
    group of items; ids: of text, the blocks or slots that it stands for."""

    __slots__ = ("sig", "kids", "opt", "rep", "ids")

    def __init__(self, sig, kids=None, opt=False, rep=False, ids=None):
        self.sig, self.kids, self.opt, self.rep, self.ids = sig, kids if kids is not None else [], opt, rep, ids if ids is not None else []


def sig_of(name: str, attributes: str) -> str:
    found = set()
    if attributes:
        for _, a, b, c in MARKS.findall(attributes):
            found.update(w for w in map(str.lower, WORDS.findall(a or b or c)) if w in KNOWN)
    return f"{name}.{'.'.join(sorted(found))}" if found else name


def parse(html: str) -> tuple[Item, list[str], list[int]]:
    """The tree of a page, the texts of its blocks in page order, and how many of each block's characters are links.

    Scripts, styles, comments and the head's title leave nothing. A text block ends at every block element and rule;
    references are decoded, white space becomes one space. Unclosed elements end with what holds them."""
    root = Item("body")
    stack, names, flat = [root], ["body"], {}
    texts: list[str] = []
    links: list[int] = []
    text: list[str] = []
    linked, in_link, pos = 0, 0, 0

    def flush():
        nonlocal linked
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                stack[-1].kids.append(Item("#", ids=[len(texts)]))
                texts.append(block)
                links.append(min(linked, len(block)))
            linked = 0

    def say(piece: str):
        nonlocal linked
        if "&" in piece:
            piece = unescape(piece)
        text.append(piece)
        if in_link:
            linked += len(piece)

    end = html.rfind(">") + 1
    while True:
        m = TOKEN.search(html, pos, end)
        if m is None:
            say(html[pos:])
            break
        if m.start() > pos:
            say(html[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not m[1]:
                closed = ENDS[name].search(html, pos)
                pos = closed.end() if closed else len(html)
                if pos >= len(html):
                    break
        elif name in BLOCKS:
            flush()
            in_link = 0
            if m[1]:
                if flat.get(name):
                    flat[name] -= 1
                    continue
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        del stack[k:], names[k:]
                        break
                    if names[k] in ("table", "td", "th", "caption") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
                continue
            if name not in KEEPS_P and "p" in names:
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == "p":
                        del stack[k:], names[k:]
                        break
                    if names[k] in ("table", "td", "th", "caption", "button"):
                        break
            if name in CLOSES:
                own, within = CLOSES[name]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in own:
                        del stack[k:], names[k:]
                        break
                    if names[k] in within:
                        break
            elif name in HEADINGS and names[-1] in HEADINGS:
                del stack[-1], names[-1]
            if len(stack) > DEPTH:
                flat[name] = flat.get(name, 0) + 1
                continue
            node = Item(sig_of(name, m[3]))
            stack[-1].kids.append(node)
            stack.append(node)
            names.append(name)
        elif name == "a":
            in_link = 0 if m[1] else 1
        elif name == "br":
            text.append(" ")
        elif name == "hr":
            flush()
    flush()
    return root, texts, links
