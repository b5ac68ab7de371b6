"""Union-free regular expressions over trees of blocks, inferred by aligning token streams.

An expression is a tree of items; an item may be optional, repeated, or a repeated group of several, and a text slot
stands for text. `fold` finds repetitions within one list of children, `align` merges two lists: a mismatch is first tried
as one more round of a repeated group and otherwise becomes an optional part. Both only ever generalise, so that the
merged expression holds what either held."""

from __future__ import annotations

import json

from corpusloom.llm.html_tree import Item


def _key(item: Item) -> str:
    return item.sig if item.sig != "(" else f"({' '.join(_key(k) for k in item.kids)})"


def _merge(a: Item, b: Item) -> Item:
    """Two items of one key as one, which is the first, changed; the second is used up."""
    a.kids = [_merge(x, y) for x, y in zip(a.kids, b.kids)] if a.sig == "(" else align(a.kids, b.kids)
    a.opt, a.rep = a.opt or b.opt, a.rep or b.rep
    a.ids += b.ids
    return a


def fold(items: list[Item]) -> list[Item]:
    """A list of siblings with its repetitions as repeated items and groups; their own children are folded already."""
    out: list[Item] = []
    keys: list[str] = []
    for item in items:
        out.append(item)
        keys.append(_key(item))
        while _fold_end(out, keys):
            pass
    return out


def _fold_end(out: list[Item], keys: list[str]) -> bool:
    """Fold the last items of a list into what stands before them, if they repeat it."""
    last = len(out) - 1
    if last < 1:
        return False
    if keys[last] == keys[last - 1]:
        out[last - 1 :] = [_repeat(_merge(out[last - 1], out[last]))]
        keys.pop()
        return True
    for j in range(last - 1, -1, -1):
        if out[j].sig == "(":  # one more round of a group
            size = len(out[j].kids)
            if last - j == size and [_key(k) for k in out[j].kids] == keys[j + 1 :]:
                out[j] = _repeat(_merge(out[j], Item("(", out[j + 1 :])))
                del out[j + 1 :], keys[j + 1 :]
                return True
        elif keys[j] == keys[last]:  # the last item closes a second round
            size = last - j
            if j - size + 1 < 0 or keys[j - size + 1 : j + 1] != keys[j + 1 :]:
                return False
            group = _repeat(_merge(Item("(", out[j - size + 1 : j + 1]), Item("(", out[j + 1 :])))
            out[j - size + 1 :] = [group]
            keys[j - size + 1 :] = [_key(group)]
            return True
    return False


def _repeat(item: Item) -> Item:
    item.rep = True
    return item


def _optional(items: list[Item]) -> list[Item]:
    for item in items:
        item.opt = True
    return items


def _rounds(group: Item, items: list[Item], at: int) -> int:
    """Merge rounds of a group that start at a place of a list into it; the place after them."""
    wanted = [_key(k) for k in group.kids]
    while [_key(k) for k in items[at : at + len(wanted)]] == wanted:
        group.kids = [_merge(x, y) for x, y in zip(group.kids, items[at : at + len(wanted)])]
        at += len(wanted)
    return at


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """Two lists of siblings as one that matches both."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_merge(x, y) for x, y in zip(a, b)]
    out: list[Item] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if ka[i] == kb[j]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if a[i].sig == "(" and (k := _rounds(a[i], b, j)) > j:
            out.append(a[i])
            i, j = i + 1, k
            continue
        if b[j].sig == "(" and (k := _rounds(b[j], a, i)) > i:
            out.append(b[j])
            i, j = k, j + 1
            continue
        in_a = next((k for k in range(i, len(a)) if ka[k] == kb[j]), None)
        in_b = next((k for k in range(j, len(b)) if kb[k] == ka[i]), None)
        if in_a is not None and (in_b is None or in_a - i <= in_b - j):
            out += _optional(a[i:in_a])
            i = in_a
        elif in_b is not None:
            out += _optional(b[j:in_b])
            j = in_b
        else:
            out += _optional([a[i], b[j]])
            i, j = i + 1, j + 1
    return fold(out + _optional(a[i:]) + _optional(b[j:]))


def infer(item: Item) -> Item:
    """A page's tree with every list of children folded."""
    item.kids = fold([infer(k) for k in item.kids])
    return item


def slots(item: Item) -> list[Item]:
    """The text slots of an expression in order."""
    return [item] if item.sig == "#" else [s for k in item.kids for s in slots(k)]


def dump(item: Item) -> str:
    def plain(x: Item):
        return [x.sig, x.opt + 2 * x.rep, [plain(k) for k in x.kids]] if x.kids else [x.sig, x.opt + 2 * x.rep]

    return json.dumps(plain(item), separators=(",", ":"))


def load(text: str) -> Item:
    def item(x) -> Item:
        return Item(x[0], [item(k) for k in x[2]] if len(x) > 2 else [], bool(x[1] & 1), bool(x[1] & 2))

    return item(json.loads(text))


def show(item: Item) -> str:
    """An expression as text: `<p>#</p>` for an element with a text slot, `( )+` repeated, `?` optional."""
    inner = "".join(show(k) for k in item.kids)
    body = "#" if item.sig == "#" else inner if item.sig == "(" else f"<{item.sig}>{inner}</{item.sig.split('.')[0]}>"
    mark = ("+" if item.rep else "") + ("?" if item.opt else "")
    return f"({body}){mark}" if mark else body
