"""Main text of web pages through wrappers inferred per host (union-free regular expressions over page structure).

A page is read into a tree of elements (tag, classes, id and role make the
label), text slots ``#`` and nothing else; inline markup belongs to its
text.  A wrapper is such a tree whose items may be optional (``?``) or
repeated (``+``), singly or as a group; there are no alternatives.

Inference aligns two sequences of items by their labels (longest common
subsequence): items that match are aligned further inside; an item that
only one side has becomes optional; neighbours of one label, and short
sequences that follow themselves, become repeated.  The pages of a host are
reduced to their distinct structures first, those are aligned in salted
groups, and the groups' wrappers once more, always in sorted order, so a
host with a third of all pages is no large group and the result does not
depend on the partitioning.

Every page is then aligned with its host's wrapper, which numbers its text
slots; a page that does not begin as the wrapper does gives no text.  Over the host's distinct
pages (equal pages count once) a slot of the wrapper is

* template, if it holds the same words on all pages that have it, and these
  are at least ``MIN_PAGES`` and ``MIN_SHARE`` of the host's pages;
* a menu, if it lies in a repeated item or group and at least ``LINK_SHARE`` of
  its characters are links;
* content otherwise.

The main text of a page are its content slots: under its own article (or
main) element where it has one, where links may be content, or else in the
body.  Elements whose tag, class, id or role names a menu, header, footer,
sidebar, notice, advert, form or comment are left out as well.

Edge cases: null and empty html give an empty text; a null url belongs to
the empty host; unclosed and stray tags are tolerated; elements may be nested
to any depth, wrappers and slot paths name the outer ``MAX_DEPTH``; text inside scripts, styles and
comments is dropped.  Rows are never merged.  Other columns are not carried.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import map_batches
from cellframe.llm.url_rules import host_of
from cellframe.session import materialize

MAX_DEPTH = 100
SALTS = 32
MAX_GROUP = 4                  # longest sequence that is folded as a repeated group
MAX_BROADCAST_BYTES = 32 << 20  # wrappers beyond this size are joined over salted keys instead
MIN_PAGES, MIN_SHARE = 3, 0.8  # distinct pages, and share of a host's, from which an unchanged text is template text
LINK_SHARE = 0.8               # share of link characters from which a repeated slot is a menu

OPTIONAL, REPEATED = 1, 2
SLOT, GROUP = "#", "("

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea",
                                                       "title", "svg", "math", "object", "xmp")}
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small "
    "span strike strong sub sup time tt u var".split())
# an open element of the first kind ends where one of the second begins
_BLOCKS = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figure footer form h1 h2 h3 "
                    "h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_ENDS = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
         "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr", "tbody"]),
         "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option", "optgroup"])}
_FENCE = frozenset("table td th ul ol dl div article section main body nav aside header footer form blockquote".split())

DROPPED_TAGS = frozenset("head nav footer aside form button select menu dialog canvas audio video map".split())
_NAMES = ("ad ads adsbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
          "sidebars cookie cookies consent gdpr notice notices newsletter subscribe popup modal overlay comment comments "
          "commentlist disqus respond reply replies share sharing social related recommended breadcrumb breadcrumbs "
          "menu nav navbar navigation topbar footer header masthead widget widgets login signup pagination pager toolbar "
          "skip alert complementary contentinfo search form")
DROPPED_NAMES = frozenset(_NAMES.split())
# a whole article may carry such a name in its own class; these tags are only dropped for their role
_KEPT_TAGS = frozenset(("article", "main", "body", "html"))
LANDMARKS = ("article", "main")


class Linked(str):
    """A piece of text inside a link."""


class Line(str):
    """A line of text with the share of its characters that are links (``link``)."""

    link = 0.0


class Node:
    """An element: label, children (nodes or pieces of text)."""

    __slots__ = ("label", "children")

    def __init__(self, label: str):
        self.label = label
        self.children: list = []


def label_of(tag: str, attributes: str) -> str:
    names = []
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            if key in ("class", "id", "role"):
                value = entities.unescape(m[2] or m[3] or m[4] or "").lower()
                names += [f"{key[0]}:{v}" for v in value.split() if not any(map(str.isdigit, v))]
    return tag + "".join("." + n for n in sorted(set(names)))


def read(page: str) -> Node:
    """The tree of a page.  Text is kept undecoded; a line break is the text "<br>"."""
    root = Node("root")
    stack, tags = [root], ["root"]
    opened = Counter(tags)  # open elements by tag
    linked = 0              # height of the stack where a link was opened
    near: list[int] = []    # places on the stack that end by themselves or fence
    passed: list[int] = []
    at, end = 0, len(page)

    def cut(k: int) -> None:
        opened.subtract(tags[k:])
        del tags[k:], stack[k:]
        while near and near[-1] >= k:
            near.pop()

    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # an unfinished tag at the end
            break
        at = m.end()
        text = m[4]
        if text is not None:
            if linked > len(stack):
                linked = 0
            stack[-1].children.append(Linked(text) if linked else text)
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            stack[-1].children.append("<br>")
        elif tag in INLINE:
            if tag == "a":
                linked = 0 if m[1] else len(stack)
        elif m[1]:
            if opened[tag]:
                k = len(tags) - 1
                while tags[k] != tag:
                    k -= 1
                cut(k)
                if not stack:
                    stack, tags = [root], ["root"]
                    opened["root"] = 1
        else:
            if tag in _RAW:
                close = _RAW[tag].search(page, at)
                at = close.end() if close else end
                continue
            while near:
                if tag in _ENDS.get(tags[near[-1]], ()):
                    cut(near[-1])
                elif tags[near[-1]] in _FENCE:
                    break
                else:
                    passed.append(near.pop())
            near += reversed([k for k in passed if k < len(tags)])
            passed.clear()
            if tag in VOID:
                stack[-1].children.append("<br>")
                continue
            if tag in _ENDS or tag in _FENCE:
                near.append(len(tags))
            opened[tag] += 1
            node = Node(label_of(tag, m[3] or ""))
            stack[-1].children.append(node)
            stack.append(node)
            tags.append(tag)
    return root


def blocks(children: list) -> Iterator[Node | str]:
    """Children with neighbouring texts joined: elements, and decoded lines that hold more than white space."""
    text: list[str] = []
    for c in [*children, None]:
        if isinstance(c, str) and c != "<br>":
            text.append(c)
            continue
        if text:
            line = Line(" ".join(entities.unescape("".join(text)).split()))
            if line:
                if links := [t for t in text if type(t) is Linked and not t.isspace()]:
                    line.link = min(1.0, len(" ".join(entities.unescape("".join(links)).split())) / len(line))
                yield line
            text = []
        if isinstance(c, Node):
            yield c


# ---- wrappers: items [label, flags, children] ------------------------------------------------------------------

def structure(node: Node, depth: int = 0) -> list:
    """The items of a page's element, folded; nothing inside elements at ``MAX_DEPTH``."""
    if depth == MAX_DEPTH:
        return []
    return fold([[SLOT, 0, []] if isinstance(c, str) else [c.label, 0, structure(c, depth + 1)]
                 for c in blocks(node.children)])


def fold(items: list) -> list:
    """Neighbours of one label become one repeated item; short sequences that follow themselves, a repeated group."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0] != GROUP:
            last = out[-1]
            out[-1] = [last[0], last[1] & item[1] & OPTIONAL | REPEATED, merge(last[2], item[2])]
        else:
            out.append(item)
    for size in range(2, MAX_GROUP + 1):
        k = 0
        while k + 2 * size <= len(out):
            a, b = out[k:k + size], out[k + size:k + 2 * size]
            if [x[0] for x in a] == [x[0] for x in b] and GROUP not in [x[0] for x in a]:
                out[k:k + 2 * size] = [[GROUP, REPEATED, merge(a, b)]]
                while [x[0] for x in out[k][2]] == [x[0] for x in out[k + 1:k + 1 + size]]:
                    out[k][2] = merge(out[k][2], out[k + 1:k + 1 + size])
                    del out[k + 1:k + 1 + size]
            k += 1
    return out


def sign(item: list) -> str:
    return item[0] if item[0] != GROUP else GROUP + ",".join(sign(x) for x in item[2])


def merge(a: list, b: list) -> list:
    """The wrapper of two sequences of items."""
    if a == b:
        return a
    la, lb = [sign(x) for x in a], [sign(x) for x in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[i] == lb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and la[i] == lb[j]:
            out.append([a[i][0], a[i][1] | b[j][1], merge(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], a[i][1] | OPTIONAL, a[i][2]])
            i += 1
        else:
            out.append([b[j][0], b[j][1] | OPTIONAL, b[j][2]])
            j += 1
    return fold(out)


def expression(items: list) -> str:
    """The wrapper as a union-free regular expression, for reading."""
    marks = {0: "", 1: "?", 2: "+", 3: "*"}

    def one(x):
        if x[0] == SLOT:
            return "#TEXT" + marks[x[1]]
        inner = expression(x[2])
        body = inner if x[0] == GROUP else f"<{x[0]}>{inner}</{x[0].split('.')[0]}>"
        return f"({body}){marks[x[1]]}" if x[1] or x[0] == GROUP else body

    return "".join(map(one, items))


def merge_all(structures: list[str]) -> str:
    """One wrapper from serialised ones, in sorted order."""
    out = None
    for s in sorted(set(structures), key=lambda s: (len(s), s)):
        items = json.loads(s)
        out = items if out is None else merge(out, items)
    return json.dumps(out or [], separators=(",", ":"))


def dropped(label: str) -> bool:
    tag, *names = label.split(".")
    if tag in DROPPED_TAGS:
        return True
    for n in names:
        kind, _, value = n.partition(":")
        if tag in _KEPT_TAGS and kind != "r":
            continue
        if not DROPPED_NAMES.isdisjoint(re.split("[-_]+", value)):
            return True
    return False


def landmark(root: Node) -> str | None:
    """The tag of the element that holds a page's main text."""
    found, todo = set(), [root]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node) and not dropped(c.label):
                found.add(c.label.split(".")[0])
                todo.append(c)
    return next((t for t in LANDMARKS if t in found), None)


class Aligner:
    """A wrapper in use: aligns a page with it and numbers the page's slots."""

    def __init__(self, wrapper: str):
        self.items = _numbered(json.loads(wrapper), False)

    def slots(self, page: str) -> Iterator[tuple[str, Line]]:
        """(slot of the wrapper, text) of a page's main region, in page order.

        A slot is named by the places of its items; the name ends in ``+`` below a repeated one and in ``@`` under
        the page's landmark.  Children go to the next item of their label, or
        to an earlier one where a repeated group begins again; below a known item a child that has none there
        (two items of one label may differ inside) is named by its label.
        """
        root = read(page)
        main = landmark(root)
        # open elements: children to come, the wrapper's items, place among them, slot name, marks, inside the main text
        open_ = [[blocks(root.children), self.items, 0, "", 0, main is None]]
        while open_:
            children, flat, k, path, marks, inside = open_[-1]
            c = next(children, None)
            if c is None:
                open_.pop()
                continue
            label = SLOT if isinstance(c, str) else c.label
            at = next((x for x in (*range(k, len(flat)), *range(0, k)) if flat[x][0] == label), None)
            if at is not None:
                open_[-1][2] = at
                path, marks = f"{path}.{at}", marks | flat[at][1]
            elif len(open_) == 1:
                continue  # no page of this wrapper begins so
            elif len(open_) <= MAX_DEPTH:
                path = f"{path}.{label}"
            if isinstance(c, str):
                if inside:
                    yield path + ("+" if marks & REPEATED else "") + ("@" if main else ""), c
                continue
            tag = label.split(".")[0]
            if dropped(label) or tag == "header" and not (main and inside):
                continue
            open_.append([blocks(c.children), flat[at][2] if at is not None else [], 0, path, marks, inside or tag == main])


def _numbered(items: list, repeated: bool) -> list:
    """The items of a wrapper in one row, groups opened: (label, flags, children)."""
    out = []
    for label, flags, children in items:
        if label == GROUP:
            out += [(x, f | flags | REPEATED, c) for x, f, c in _numbered(children, True)]
        else:
            out.append((label, flags, _numbered(children, False)))
    return out


def page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("_key"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_text"),
                        host_of(F.col(url_col).cast("string")).alias("_host"),
                        F.col(url_col).cast("string").alias("_url"))


def structures(rows: DataFrame) -> DataFrame:
    """``host`` and ``structure`` of every page."""

    def fn(rb: pa.RecordBatch) -> dict:
        shapes = [json.dumps(structure(read(page)), separators=(",", ":")) for page in rb.column(1).to_pylist()]
        return {"host": rb.column(2), "structure": shapes}

    return map_batches(rows, fn, "host string, structure string")


def infer(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          salts: int = SALTS) -> DataFrame:
    """``host`` and ``wrapper`` (serialised)."""
    found = structures(page_rows(pages, id_col, url_col, html_col))
    distinct = found.groupBy("host", "structure").agg(F.lit(1).alias("one"))
    partial = (distinct.groupBy("host", F.pmod(F.xxhash64("structure"), F.lit(salts)).alias("salt"))
               .agg(F.collect_list("structure").alias("structures")))
    return _merge(_merge(partial, "structure").groupBy("host").agg(F.collect_list("structure").alias("structures")),
                  "wrapper")


def _merge(rows: DataFrame, name: str) -> DataFrame:
    def fn(rb: pa.RecordBatch) -> dict:
        return {"host": rb.column(0), name: [merge_all(s) for s in rb.column(2).to_pylist()]}

    return map_batches(rows.select("host", F.lit("").alias("_text"), "structures"), fn, f"host string, {name} string")


_ALIGNERS: dict[str, Aligner] = {}


def aligner(wrapper: str) -> Aligner:
    if wrapper not in _ALIGNERS:
        if len(_ALIGNERS) >= 2_000:
            _ALIGNERS.clear()
        _ALIGNERS[wrapper] = Aligner(wrapper)
    return _ALIGNERS[wrapper]


def _with_host(rows: DataFrame, table: DataFrame, size: int, salts: int) -> DataFrame:
    """Rows joined with a table of one row per host: broadcast up to a measured size, over salted hosts beyond it."""
    if size <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "_host", "left")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(
        spread, ["_host", "_salt"], "left").drop("_salt")


def aligned(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", salts: int = SALTS) -> DataFrame:
    """Every page with its slots: ``_key, _url, _host, slots`` (array of ``slot, text``), ``page`` (a hash of them) and
    ``parts`` (per slot a hash of its texts, their characters and those in links)."""
    import xxhash
    rows = page_rows(pages, id_col, url_col, html_col)
    wrappers = materialize(wrappers.select(F.col("host").alias("_host"), "wrapper"), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + 100)).first()[0] or 0
    joined = _with_host(rows, wrappers, size, salts)

    def fn(rb: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"slots": [], "page": [], "parts": []}
        for page, w in zip(rb.column(1).to_pylist(), rb.column(4).to_pylist()):
            found = list(aligner(w or "[]").slots(page)) if page else []
            by: dict[str, list[Line]] = {}
            for slot, line in found:
                by.setdefault(slot, []).append(line)
            out["slots"].append([(slot, str(line)) for slot, line in found])
            out["page"].append(xxhash.xxh3_128_digest("\n".join(f"{slot} {line}" for slot, line in found).encode()))
            out["parts"].append([(slot, xxhash.xxh64_intdigest("\n".join(t).encode()) >> 1, sum(map(len, t)),
                                  sum(len(x) * x.link for x in t)) for slot, t in by.items()])
        return {"_key": rb.column(0), "_url": rb.column(2), "_host": rb.column(3), **out}

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(joined.select("_key", "_text", "_url", "_host", "wrapper"), fn,
                       f"_key {kind}, _url string, _host string, slots array<struct<slot:string,text:string>>, page binary, "
                       "parts array<struct<slot:string,h:long,chars:long,links:double>>")


def roles(found: DataFrame) -> DataFrame:
    """``_host`` and ``drop``: the slots of the host's wrapper that are template or menus."""
    # equal pages are one page, however many copies there are
    distinct = found.where(F.size("parts") > 0).groupBy("_host", "page").agg(F.first("parts").alias("parts"))
    slot = distinct.select("_host", F.inline("parts")).groupBy("_host", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("chars").alias("chars"),
        F.sum("links").alias("links"))
    n_pages = distinct.groupBy("_host").agg(F.count(F.lit(1)).alias("pages"))
    template = ((F.col("lo") == F.col("hi")) & (F.col("n") >= MIN_PAGES) & (F.col("n") >= MIN_SHARE * F.col("pages")))
    menu = (~F.col("slot").contains("@") & F.col("slot").contains("+")
            & (F.col("links") >= LINK_SHARE * F.col("chars")))
    return (slot.join(n_pages, "_host").where(template | menu)
            .groupBy("_host").agg(F.array_sort(F.collect_list("slot")).alias("drop")))


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", salts: int = SALTS) -> DataFrame:
    """One row per page: id, url, ``text`` (blocks joined by line ends), ``n_chars``."""
    found = materialize(aligned(pages, wrappers, id_col, url_col, html_col, salts), "page-slots")
    drop = materialize(roles(found), "slot-roles")
    size = drop.agg(F.sum(F.length(F.array_join("drop", ",")) + 100)).first()[0] or 0
    none = F.expr("cast(array() as array<string>)")
    joined = _with_host(found, drop, size, salts).withColumn("drop", F.coalesce("drop", none))
    kept = F.filter("slots", lambda s: ~F.array_contains("drop", s["slot"]))
    text = F.array_join(F.transform(kept, lambda s: s["text"]), "\n")
    return joined.select(F.col("_key").alias(id_col), F.col("_url").alias(url_col), text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """Infer the wrappers of all hosts and apply them to every page."""
    return extract(pages, infer(pages, id_col, url_col, html_col), id_col, url_col, html_col)
