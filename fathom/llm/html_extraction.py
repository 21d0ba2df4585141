"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of its block elements with text slots; inline markup is no structure. Pages of one host are
aligned one after the other: a wrapper node lists its children in order, each with whether some pages lack it
(optional) and whether neighbours with the same label repeat (a repeated group). Wrappers align with each other
in the same way, so partial wrappers of partitions are merged into one for each host, and a host with many
pages is no larger a job than others. A wrapper records for each node how many pages have it, how much text its
slots hold, and whether that text differs between pages.

The host's wrapper says where the article is, for each shape of its pages: the nodes that hold nearly all of the
text that varies and is no link, article and main elements being a hint only. A page takes the one of these regions
that holds the most of its own text. Its main text is what stands there, less parts that are the same on all pages
that have them, menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments, known by element or by the whole name of a
class or id; names that articles use as well count only where the part is mostly links or the
same on other pages. A page that fits no region of its host, or has no other page beside it, is its own wrapper.

A wrapper ends at paragraphs, lists, tables and the like and at parts to be left out, and names of more than a few
words (those of single pages) are no part of a label, so that it is as large as the host's templates and nothing of it
is pruned. Elements more than DEPTH deep are read as part of the one at that depth, as browsers do; their text stays.
Regions are broadcast only if they fit in BROADCAST_BYTES, else joined by host. A null html is empty, a null url is
a host of its own. Broken markup is read as far as it goes.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

DEPTH = 200  # elements inside each other
NAME_WORDS = 3  # of a class or id that is part of a label; longer ones are made for single pages
BROADCAST_BYTES = 16 << 20
HOSTS = 5000  # partial wrappers held by a task at once

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(?=[/a-zA-Z][^<>]*\Z)[^<>]*\Z", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}  # what they hold is no markup
CLOSED = {k: re.compile(f"</{k}(?=[\\s/>])[^>]*>?", re.I) for k in RAW}
ALONE = {"button", "select", "noscript", "datalist"}  # left out, and never inside themselves
TAGS = {k: re.compile(f"<(/?){k}(?=[\\s/>])", re.I) for k in [*sorted(ALONE), "template"]}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
UNBROKEN = {*INLINE, *ALONE, "template", "head"}  # what stands before and after these is one block
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE = {*ALONE, "template", "nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "gdpr", "header", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "respond", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "search",
}
# Words that name a part to be left out by themselves; the others also name parts of articles, so that the page or its host has to confirm them.
SURE = ASIDE_WORDS - {"banner", "comment", "complementary", "header", "menu", "notice", "notices", "promo", "related", "respond", "search", "share", "social", "sponsor", "widget"}
# Words that may stand beside those of ASIDE_WORDS in a name; PREFIXES only make a name to be confirmed.
AFFIXES = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "desktop", "fixed", "form", "global", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "primary", "region", "right", "secondary", "side", "site", "slot", "sticky", "sub", "top", "unit", "wrap", "wrapper"}
PREFIXES = {"article", "blog", "entry", "post"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
REGION = ("article", "main")
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "table", "tbody", "tr", "td", "figure", "dl", "dd", "dt"}


class Node:
    """An element of a page: label, children in order (nodes and texts), characters of its own texts that are links.

    aside: 0, or to be left out: 1 by a word of its class or id that needs to be confirmed, 2 by a sure one, 3 by element.
    """

    __slots__ = ("label", "kids", "aside", "linked", "weak", "home")

    def __init__(self, label: str, aside: int, home: "Node | None" = None):
        """An element that is too deep has a home, the one that its text is read as part of."""
        self.label, self.kids, self.aside, self.linked, self.weak = label, [] if home is None else home.kids, aside, 0, aside == 1
        self.home = home or self


def _named_aside(parts: list[str], role: bool) -> int:
    """How surely a class, id or role names a part to be left out: its words are known ones, or known beside them."""
    whole = "".join(parts)
    if role or whole in ASIDE_WORDS:
        return (2 if role or whole in SURE else 1) if whole in ASIDE_WORDS else 0
    rest = [w for w in parts if w not in ASIDE_WORDS]
    if len(rest) == len(parts) or any(w not in AFFIXES and w not in PREFIXES for w in rest):
        return 0
    return 2 if PREFIXES.isdisjoint(rest) and any(w in SURE for w in parts) else 1


def _label(name: str, rest: str) -> tuple[str, int]:
    words: list[str] = []
    aside = 3 if name in ASIDE else 0
    plain = name in HEADINGS or name in ("body", "html", *REGION)  # never left out for a name
    if rest and "=" in rest:
        for kind, *values in NAMED.findall(rest):
            for value in next((v for v in values if v), "").split():
                parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]
                if len(parts) <= NAME_WORDS:
                    words += parts if len(parts) < 2 else [*parts, "".join(parts)]
                if parts and not plain:
                    aside = max(aside, _named_aside(parts, kind.lower() == "role"))
    return ".".join([name, *sorted(set(words))]), aside


def _settle(root: Node) -> None:
    """Decides on the parts known by name: one that needs to be confirmed is left out if it is mostly links; one that
    holds most of the page, as a form around all of it does, is kept."""

    def walk(node: Node) -> tuple[int, int, bool]:
        size, linked, article = 0, node.linked, node.label.partition(".")[0] in ("article", "main", "h1")
        for k in node.kids:
            if isinstance(k, str):
                size += len(k.strip())
            else:
                n, m, has = walk(k)
                size, linked, article = size + n, linked + m, article or has
        if node.aside in (1, 2) or node.label.partition(".")[0] == "form":
            held.append((node, size, linked, article))
        return size, linked, article

    held: list[tuple[Node, int, int, bool]] = []
    total = walk(root)[0]
    for node, size, linked, article in held:
        if node.aside == 1 and 2 * linked <= size or 2 * size > total and (node.aside != 2 or article):
            node.aside = 0


def _is_closed(page: str, name: str, at: int) -> bool:
    """Whether an element to be left out that starts before ``at`` has an end; without one only its tag is passed over."""
    if name not in TAGS:
        return True
    tags = TAGS[name].finditer(page, at)
    return any(m.group(1) for m in tags) if name not in ALONE else bool((m := next(tags, None)) and m.group(1))


def parse(page: str) -> Node:
    """The tree of a page; what scripts, styles and other raw elements hold is left out, references are decoded."""
    root = Node("page", 0)
    stack = [root]
    at, link = 0, False

    def text(to: int) -> None:
        if to > at:
            s = html.unescape(page[at:to])
            kids = stack[-1].kids
            if link:
                stack[-1].home.linked += len(s.strip())
            if kids and isinstance(kids[-1], str):
                kids[-1] += s
            else:
                kids.append(s)

    def opened(node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)

    while m := TOKEN.search(page, at):
        close, name = m.group(1), (m.group(2) or "").lower()
        text(m.start())
        at = m.end()
        if not name:
            continue
        if name == "a":
            link = not close and "href" in m.group(3).lower()
        if not close:
            if name in RAW:
                if m.group(3).endswith("/") and any(n.label.partition(".")[0] in ("svg", "math") for n in stack):
                    continue
                if end := CLOSED[name].search(page, at):
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(page)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    stack[-1].kids.append("\n")
                continue
            if name in INLINE:
                label, aside = _label(name, m.group(3))
                if aside:  # inline markup counts as structure only where it is to be left out
                    opened(Node(label, aside))
                continue
            if name in CLOSES_P:
                _close(stack, "p", ("article", "main", "div", "section", "td", "li", "body"))
            for same in SAME.get(name, ()):
                _close(stack, same, ("ul", "ol", "dl", "table", "select", "datalist"))
            if not _is_closed(page, name, at) or m.group(3).endswith("/") and name in ("svg", "math"):
                continue
            label, aside = _label(name, m.group(3))
            if len(stack) < DEPTH or aside and stack[-1].home.aside == 0:
                opened(Node(label, aside))
            else:
                stack[-1].kids.append("\n")
                stack.append(Node(label, 0, stack[-1].home))
        elif name not in VOID and name not in RAW:
            _close(stack, name, ())
    text(len(page))
    _settle(root)
    return root


def _close(stack: list[Node], name: str, stop: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        own = stack[k].label.partition(".")[0]
        if own == name:
            if stack[k].home is not stack[k]:
                stack[k].kids.append("\n")
            del stack[k:]
            return
        if own in stop:
            return


# --- wrappers ----------------------------------------------------------------------------------------------
# A wrapper node: {"l": label, "n": pages, "t": characters in own slots that are no links, "h": hash of the text, or None if it
# differs between pages, "a": left out, "o": optional, "r": repeated, "k": children}


def wrapper(node: Node) -> dict:
    """The wrapper of one page: neighbours with the same label are folded into a repeated group."""
    leaf = node.aside or node.label.partition(".")[0] in LEAVES
    if leaf:
        inner: list[str] = []
        _collect(node, inner, False)
        own, size = " ".join("".join(inner).split()), _size(node)
    else:
        own = " ".join(" ".join(k for k in node.kids if isinstance(k, str)).split())
        size = max(0, len(own) - node.linked)
    out = {"l": node.label, "n": 1, "t": size, "h": own if len(own) <= 64 else xxhash.xxh3_64_hexdigest(own), "a": bool(node.aside), "o": False, "r": False, "k": []}
    for kid in () if leaf else node.kids:
        if isinstance(kid, str):
            continue
        w = wrapper(kid)
        last = out["k"][-1] if out["k"] else None
        if last and last["l"] == w["l"]:
            pages = last["n"]
            _merge(last, w)
            last["n"], last["r"] = pages, True
        else:
            out["k"].append(w)
    return out


def _merge(a: dict, b: dict) -> None:
    """Aligns wrapper b with a: matched children merge, others become optional."""
    a["t"] += b["t"]
    a["h"] = a["h"] if a["h"] == b["h"] else None
    a["a"] &= b["a"]
    a["o"] |= b["o"]
    a["r"] |= b["r"]
    pages_a, pages_b = a["n"], b["n"]
    a["n"] += b["n"]
    kids: list[dict] = []
    x, y = a["k"], b["k"]
    i = j = 0
    for p, q in [*_aligned([k["l"] for k in x], [k["l"] for k in y]), (len(x), len(y))]:
        for rest, upto, start in ((x, p, i), (y, q, j)):
            for k in rest[start:upto]:
                k["o"] = True
                kids.append(k)
        if p < len(x):
            _merge(x[p], y[q])
            x[p]["o"] |= x[p]["n"] < pages_a + pages_b
            kids.append(x[p])
        i, j = p + 1, q + 1
    folded: list[dict] = []
    for k in kids:  # neighbours that came together are one repeated group
        if folded and folded[-1]["l"] == k["l"]:
            _merge(folded[-1], k)
            folded[-1]["r"] = True
        else:
            folded.append(k)
    a["k"] = folded


def _aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    if x == y:
        return [(i, i) for i in range(len(x))]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    # Bit j of rows[i] is 0 where taking b[j] lengthens the longest common subsequence of a[:i] and b[:j].
    where: dict[str, int] = {}
    for j, label in enumerate(b):
        where[label] = where.get(label, 0) | 1 << j
    all_ = (1 << len(b)) - 1
    rows = [all_]
    for label in a:
        v = rows[-1]
        u = v & where.get(label, 0)
        rows.append((v + u | v - u) & all_)
    middle = []
    i, j = len(a), len(b) - 1
    while i and j >= 0:
        if rows[i] >> j & 1:  # b[j] is not needed
            j -= 1
        elif not rows[i - 1] >> j & 1:  # nor is a[i - 1]
            i -= 1
        else:
            i -= 1
            middle.append((head + i, head + j))
            j -= 1
    return [*((k, k) for k in range(head)), *reversed(middle), *((len(x) - tail + k, len(y) - tail + k) for k in range(tail))]


def _mass(w: dict) -> dict[int, int]:
    """Characters below each node, by id, that may be an article's: they vary between pages, if there are several."""
    out: dict[int, int] = {}
    one = w["n"] < 2

    def walk(node: dict) -> int:
        if node["a"]:
            return 0
        own = node["t"] if one or node["h"] is None or node["r"] else 0
        out[id(node)] = own = own + sum(map(walk, node["k"]))
        return own

    walk(w)
    return out


def expression(w: dict) -> str:
    """The wrapper as a union-free regular expression of elements and text slots."""
    inner = ("#text " if w["h"] is None else "#fixed " if w["h"] else "") + " ".join(expression(k) for k in w["k"])
    one = f"<{w['l']}>{inner.strip()}</>"
    return f"({one})" + ("*" if w["o"] and w["r"] else "+" if w["r"] else "?") if w["o"] or w["r"] else one


def _code(path: list[str]) -> int:
    return zlib.crc32(" ".join(path).encode())


def _fixed(w: dict) -> tuple[list[int], list[int]]:
    """Codes of the ways to nodes whose text is the same on all pages that have them: (parts outside of article and main
    elements, on three pages at least; any part, on two at least)."""
    parts: dict[int, bool] = {}
    same: dict[int, bool] = {}

    def walk(node: dict, path: list[str], inside: bool) -> tuple[bool, bool]:
        name = node["l"].partition(".")[0]
        inside |= name in REGION
        kids = [walk(k, [*path, k["l"]], inside) for k in node["k"]]
        fixed = node["h"] is not None and all(f for f, _ in kids)
        full = bool(node["h"]) or any(t for _, t in kids)
        code = _code(path)
        same[code] = same.get(code, True) and fixed and full and node["n"] > 1
        parts[code] = parts.get(code, True) and fixed and full and node["n"] > 2 and not inside and name not in LEAVES
        return fixed, full

    walk(w, [], False)
    return [c for c, ok in parts.items() if ok], [c for c, ok in same.items() if ok]


def region(w: dict | None, hints: bool = True) -> dict | None:
    """Where the article is: "paths", labels on the way from the root to it, one for each shape of pages; "parts" and
    "same", codes of the parts that do not vary. None where nothing varies. Without ``hints``, article and main elements
    count like others."""
    if w is None:
        return None
    mass = _mass(w)
    total = mass.get(id(w), 0)
    if not total:
        return None
    pages: dict[int, int] = {}

    def count(node: dict, most: int) -> bool:
        pages[id(node)] = n = min(node["n"], most)
        name = node["l"].partition(".")[0]
        title[id(node)] = any([count(k, n) for k in node["k"]]) or name == "h1"
        return title[id(node)] and not node["a"]

    title: dict[int, bool] = {}
    count(w, w["n"])
    paths: list[list[str]] = []
    while pages[id(w)] > 0 and mass[id(w)] > total / 50:
        node, way = w, [w]
        while True:
            each = mass[id(node)] / max(1, pages[id(node)])
            inside = hints and _is_region(node)
            best = None
            for k in node["k"]:
                m = mass.get(id(k), 0)
                hint = hints and _is_region(k)
                if not m or k["l"].partition(".")[0] in LEAVES or inside and not hint:
                    continue
                share = m / max(1, pages[id(k)]) / each
                lone = not any(title[id(x)] and x is not k and not x["a"] and not x["o"] for x in node["k"])
                if share >= (0.5 if hint else 0.8) and (hint or lone) and (best is None or (hint, m) > best[0]):
                    best = (hint, m), k
            if best is None:
                break
            node = best[1]
            way.append(node)
        paths.append([x["l"] for x in way[1:]])
        m, n = mass[id(node)], pages[id(node)]
        if not m or paths[-1] in paths[:-1]:
            paths.pop()
            break
        for x in way:
            mass[id(x)] -= m
            pages[id(x)] -= n
    parts, same = _fixed(w) if w["n"] > 1 else ([], [])
    return {"paths": paths, "parts": parts, "same": same}


def _is_region(node: dict) -> bool:
    name, _, words = node["l"].partition(".")
    return name in REGION or words == "main"


# --- extraction --------------------------------------------------------------------------------------------


def _collect(node: Node, out: list[str], inside: bool) -> None:
    for k in node.kids:
        if isinstance(k, str):
            out.append(k)
        elif not k.aside or (inside and k.label.partition(".")[0] == "header" and _has_title(k)):
            gap = "" if k.label.partition(".")[0] in INLINE else "\n"
            out.append(gap)
            _collect(k, out, inside)
            out.append(gap)
        elif k.label.partition(".")[0] not in UNBROKEN:
            out.append("\n")


def _has_title(node: Node) -> bool:
    return any(not isinstance(k, str) and (k.label.partition(".")[0] == "h1" or _has_title(k)) for k in node.kids)


def _at(node: Node, path: list[str]) -> list[Node]:
    if not path:
        return [node]
    return [x for k in node.kids if not isinstance(k, str) and k.label == path[0] for x in _at(k, path[1:])]


def _size(node: Node) -> int:
    """Characters that are no links, in no part to be left out."""
    return max(0, sum(len(k.strip()) for k in node.kids if isinstance(k, str)) - node.linked) + sum(_size(k) for k in node.kids if not isinstance(k, str) and not k.aside)


def _mark(node: Node, path: list[str], parts: set[int], same: set[int]) -> None:
    """Leaves out what does not vary on the host."""
    for k in node.kids:
        if not isinstance(k, str) and not k.aside:
            way = [*path, k.label]
            code = _code(way)
            if code in parts or k.weak and code in same:
                k.aside = 3
            else:
                _mark(k, way, parts, same)


def main_text(page: str | None, known: dict | None = None) -> str:
    """Main text of a page, given its host's region()."""
    if not page:
        return ""
    root = parse(page)
    if known and (known["parts"] or known["same"]):
        _mark(root, [], set(known["parts"]), set(known["same"]))
    whole = _size(root)
    path, found, most = [], [], 0
    for p in known["paths"] if known else ():
        nodes = [x for x in _at(root, p) if not x.aside]
        if (size := sum(map(_size, nodes))) > most:
            path, found, most = p, nodes, size
    if not found or 2 * most < whole:  # another shape than the host's: the page is its own wrapper
        own = region(wrapper(root))
        path = own["paths"][0] if own else []
        found = [x for x in _at(root, path) if not x.aside]
    inside = bool(path) and path[-1].partition(".")[0] not in ("html", "body")
    out: list[str] = []
    for node in found:
        _collect(node, out, inside)
        out.append("\n")
    return " ".join("".join(out).split())


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _partial(batches):
    """Wrappers of the pages of a task, by host."""
    held: dict[str, dict] = {}
    for b in C.pieces(batches, "html"):
        for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            if h:
                w, key = wrapper(parse(h)), host(u)
                if key in held:
                    _merge(held[key], w)
                else:
                    held[key] = w
        if len(held) > HOSTS:
            yield _written(held)
            held = {}
    if held:
        yield _written(held)


def _written(held: dict[str, dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], names=["host", "wrapper"])


def _whole(write):
    """Partial wrappers, ordered by host -> what is to be written of one for each host."""

    def run(batches):
        key, now = None, None
        for b in batches:
            out: dict[str, dict] = {}
            for h, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                w = json.loads(w)
                if h == key:
                    _merge(now, w)
                else:
                    if now is not None:
                        out[key] = now
                    key, now = h, w
            if out:
                yield write(out)
        if now is not None:
            yield write({key: now})

    return run


def _parts(pages: DataFrame) -> DataFrame:
    parts = pages.select("url", "html").mapInArrow(_partial, "host string, wrapper string")
    return parts.repartition(C.fan_out(pages), "host").sortWithinPartitions("host")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of every host."""
    return _parts(pages).mapInArrow(_whole(_written), "host string, wrapper string")


def _regions(held: dict[str, dict]) -> pa.RecordBatch:
    path = {h: p for h, w in held.items() if w["n"] > 1 and (p := region(w))}
    return pa.RecordBatch.from_arrays([pa.array(list(path), pa.string()), pa.array([json.dumps(p) for p in path.values()], pa.string())], names=["host", "region"])


def _extracted(regions):
    def run(batches):
        known = regions.value if regions else None
        for b in C.pieces(batches, "html"):
            given = b.column("region").to_pylist() if known is None else [known.get(host(u)) for u in b.column("url").to_pylist()]
            text = [main_text(h, json.loads(r) if r else None) for h, r in zip(b.column("html").to_pylist(), given, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _with_host(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host(u) for u in b.column("url").to_pylist()], pa.string())], names=[*b.schema.names, "host"])


def html_extraction(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    pages needs page_id, url and html.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    C.small_batches(pages.sparkSession)
    # hosts of one page need no entry: the page is its own wrapper
    found = C.checkpointed(_parts(pages).mapInArrow(_whole(_regions), "host string, region string"))
    size = found.agg(F.sum(F.length("host") + F.length("region") + 100)).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"
    if size <= broadcast_bytes:
        known = {r.host: r.region for r in found.collect()}  # at most broadcast_bytes
        return pages.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(known)), schema)
    keyed = pages.mapInArrow(_with_host, "page_id long, url string, html string, host string")
    return keyed.join(found, "host", "left").select("page_id", "url", "html", "region").mapInArrow(_extracted(None), schema)
