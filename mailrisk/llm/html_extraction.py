"""Main text of web pages by wrappers inferred from the pages of a host.

A wrapper is a regular expression without unions over tags and text slots. A page is a token stream, in which
adjacent repeats are folded into repeated groups. Two streams of one host are aligned: what both have
stays, a group one of them has folded is folded in the other, and what only one has becomes an
optional group, until all streams of the host are explained by one wrapper.

Pages with the same stream are counted before anything is shuffled. The distinct streams of a host are aligned
in rounds of hashed buckets, so that no task sees all streams of a large host. The wrapper is then
read once for the article: its slots are the article's or not by the containers around them, and a
page's text is taken from the article's slots, by the first choice of containers that gives the page any text. Page bodies are not shuffled unless the
wrappers outgrow a broadcast.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.url_filters import url_host
from mailrisk.session import materialise

BUCKETS = (4096, 64, 1)
LONGEST_GROUP = 12

# Fixed values of HTML: elements by what they do to text.
_HIDDEN = {"script", "style", "template", "svg", "head", "title", "textarea", "select", "button", "iframe", "object",
           "noscript", "canvas", "audio", "video", "math"}
_RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
           "time", "tt", "u", "var", "wbr"}
_CLOSED_BY = {  # an open element on the left is closed by the start of one on the right
    "p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}
_PAGE_PARTS = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "fieldset"}
_WHOLE = {"html", "body", "main", "article"}
_PART_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|login|menu|modal|"
    r"nav\w*|newsletter|notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|"
    r"toolbar|widget)(?:$|[-_ ])", re.I)
_MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article|body|content|entry|main|post|story|text)(?:$|[-_ ])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(_RAW) + r")\b(?P<rawattr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")


def _name(tag: str, attributes: str) -> str:
    """Symbol of an element: its tag and what its class, id and role say, digits left out."""
    if not attributes or "=" not in attributes:
        return tag
    found = [f"{k.lower()}={_DIGITS.sub('0', a or b or c)}" for k, a, b, c in _ATTRIBUTE.findall(attributes)]
    return " ".join([tag, *found])


def stream(html: str | None) -> Iterator[tuple[str, object]]:
    """Events ``open`` and ``close`` (element symbol, for all but inline elements), ``space`` and ``text``."""
    html = html or ""
    stack: list[str] = []
    last = 0
    for m in _TOKEN.finditer(html):
        if m.start() > last:
            yield "text", html[last : m.start()]
        last = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in _INLINE:
            if tag == "br":
                yield "space", None
            continue
        if m["end"]:
            if any(s.split(" ", 1)[0] == tag for s in stack):
                while True:
                    top = stack.pop()
                    yield "close", top
                    if top.split(" ", 1)[0] == tag:
                        break
            else:
                yield "close", None
            continue
        while stack and tag in _CLOSED_BY.get(stack[-1].split(" ", 1)[0], ()):
            yield "close", stack.pop()
        name = _name(tag, m["attr"])
        yield "open", name
        if tag in _VOID or m["attr"].endswith("/"):
            yield "close", name
        else:
            stack.append(name)
    if last < len(html):
        yield "text", html[last:]
    while stack:
        yield "close", stack.pop()


# A wrapper is a list of nodes: ["t"] a text slot, ["e", symbol, nodes] an element, ["g", mark, nodes] a group that
# repeats (+), is optional (?) or both (*).


def _fold(nodes: list) -> list:
    """Replace adjacent repeats by repeated groups, short periods first."""
    for width in range(1, LONGEST_GROUP + 1):
        out: list = []
        i = 0
        while i < len(nodes):
            body = nodes[i : i + width]
            j = i + width
            while len(body) == width and nodes[j : j + width] == body:
                j += width
            if j > i + width and not (width == 1 and body[0][0] == "g"):
                out.append(["g", "+", body])
                i = j
            elif j > i + width:
                out.append(body[0])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def skeleton(html: str | None) -> list:
    """Token stream of a page as a wrapper of its own."""
    levels: list[list] = [[]]
    names: list[str] = []
    for kind, value in stream(html):
        here = levels[-1]
        if kind == "text":
            if value.strip() and not (here and here[-1] == ["t"]):
                here.append(["t"])
        elif kind == "open":
            names.append(value)
            levels.append([])
        elif kind == "close" and value is not None:
            body = _fold(levels.pop())
            levels[-1].append(["e", names.pop(), body])
    return _fold(levels[0])


def _key(node: list) -> str:
    return node[1] if node[0] == "e" else "#" if node[0] == "t" else "(" + " ".join(map(_key, node[2])) + ")"


def _strip(node: list) -> list[list]:
    """The nodes a group stands for, any other node itself."""
    return node[2] if node[0] == "g" else [node]


def _optional(nodes: list) -> list:
    out = []
    for node in nodes:
        if node[0] == "g":
            out.append(["g", "*" if node[1] in "+*" else "?", node[2]])
        else:
            out.append(["g", "?", [node]])
    return out


def _refold(nodes: list, other: list) -> list:
    """Fold single occurrences of the bodies that the other side repeats."""
    bodies = {" ".join(map(_key, g[2])): len(g[2]) for g in other if g[0] == "g" and g[1] in "+*"}
    if not bodies:
        return nodes
    out: list = []
    i = 0
    while i < len(nodes):
        width = next((w for b, w in bodies.items() if " ".join(map(_key, nodes[i : i + w])) == b), 0)
        if not width:
            out.append(nodes[i])
            i += 1
            continue
        run = nodes[i : i + width]
        if out and out[-1][0] == "g" and out[-1][1] in "+*" and [_key(n) for n in out[-1][2]] == [_key(n) for n in run]:
            out[-1] = ["g", out[-1][1], align(out[-1][2], run)]
        else:
            out.append(["g", "+", run])
        i += width
    return out


def align(a: list, b: list) -> list:
    """Wrapper that explains both: aligned by symbols, mismatches become optional, repeats are shared."""
    if a == b:
        return a
    a, b = _refold(a, b), _refold(b, a)
    out: list = []
    ka, kb = [[_key(["g", "", _strip(n)]) for n in x] for x in (a, b)]
    for kind, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                inner = [_join(p, q) for p, q in zip(_strip(x), _strip(y))]
                marks = {n[1] for n in (x, y) if n[0] == "g"}
                repeats, free = bool(marks & {"+", "*"}), bool(marks & {"?", "*"})
                mark = "*" if repeats and free else "+" if repeats else "?" if free else ""
                out += [["g", mark, inner]] if mark else inner
        else:
            out += _optional(a[i:j]) + _optional(b[k:m])
    return _merge_options(out)


def _join(x: list, y: list) -> list:
    if x[0] == "e":
        return ["e", x[1], align(x[2], y[2])]
    if x[0] == "g":
        return ["g", max(x[1], y[1], key="?+*".index), align(x[2], y[2])]
    return x


def _merge_options(nodes: list) -> list:
    """Two neighbouring groups with the same body are one that repeats."""
    out: list = []
    for node in nodes:
        if node[0] == "g" and out and out[-1][0] == "g" and _key(out[-1]) == _key(node):
            both = {out[-1][1], node[1]}
            inner = [_join(p, q) for p, q in zip(out[-1][2], node[2])]
            out[-1] = ["g", "+" if both == {"+"} else "*", inner]
        else:
            out.append(node)
    return out


def _is_part(name: str) -> bool:
    tag, _, names = name.partition(" ")
    if tag in _WHOLE:  # their names tell of the page's layout
        return False
    return tag in _PAGE_PARTS or tag in _HIDDEN or bool(names and _PART_NAMES.search(names.replace("=", " ")))


def _paths(nodes: list, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], bool]]:
    """Container paths of a wrapper, with whether they hold a text slot themselves."""
    for node in nodes:
        if node[0] == "t":
            yield at, True
        elif node[0] == "g":
            yield from _paths(node[2], at)
        else:
            yield (*at, node[1]), False
            yield from _paths(node[2], (*at, node[1]))


def article_paths(wrapper: list) -> list[set[tuple[str, ...]]]:
    """Choices of slots for the article, best first: below the outermost article, else main, else a container named as
    such, else the body, and below no part of the page.

    Pages of one host may differ in template, so a page takes the first choice in which it has text.
    """
    paths = list(_paths(wrapper))
    open_ = [(p, t) for p, t in paths if not any(_is_part(x) for x in p)]
    tests = (
        lambda x: x.partition(" ")[0] == "article",
        lambda x: x.partition(" ")[0] == "main" or "role=main" in x,
        lambda x: " " in x and bool(_MAIN_NAMES.search(x.partition(" ")[2].replace("=", " "))),
        lambda x: True,
    )
    choices = []
    for test in tests:
        slots = {p for p, text in open_ if text and (any(map(test, p)) or test is tests[-1])}
        if slots and slots not in choices:
            choices.append(slots)
    return choices


def article(html: str | None, choices: list[set[tuple[str, ...]]]) -> str:
    """Text of the first choice of slots that holds any."""
    return next(filter(None, (extract(html, slots) for slots in choices)), "")


def extract(html: str | None, slots: set[tuple[str, ...]]) -> str:
    """Text of the slots: blocks in page order, references decoded, white space within a block as one space."""
    blocks: list[str] = []
    path: list[str] = []
    text: list[str] = []

    def end_block() -> None:
        if text:
            block = " ".join(unescape("".join(text)).split())
            if block:
                blocks.append(block)
            text.clear()

    for kind, value in stream(html):
        if kind == "text":
            if tuple(path) in slots:
                text.append(value)
        elif kind == "space":
            if text:
                text.append(" ")
        else:
            end_block()
            if kind == "open":
                path.append(value)
            elif value is not None:
                path.pop()
    end_block()
    return "\n".join(blocks)


def _skeleton_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: json.dumps(skeleton(h), separators=(",", ":")))

    return of(F.coalesce(html, F.lit("")))


def _align_group(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in sorted(rows["wrapper"]):
        nodes = json.loads(text)
        wrapper = nodes if wrapper is None else align(wrapper, nodes)
    return pd.DataFrame({
        "host": [rows["host"].iloc[0]], "hash": [rows["hash"].iloc[0]],
        "wrapper": [json.dumps(wrapper, separators=(",", ":"))], "pages": [int(rows["pages"].sum())],
    })


def infer_wrappers(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``host``, ``wrapper`` (JSON) and ``pages`` for every host, over all its pages.

    A null url or one without a host belongs to the host named by the empty string. A null page is empty.
    """
    streams = pages.select(url_host(F.col(url)).alias("host"), _skeleton_column(F.col(html)).alias("wrapper"))
    found = streams.groupBy("host", "wrapper").agg(F.count(F.lit(1)).alias("pages"))
    found = found.withColumn("hash", F.xxhash64("wrapper"))
    for n in BUCKETS:
        bucket = F.pmod(F.col("hash"), F.lit(n)).alias("bucket")
        found = found.groupBy("host", bucket).applyInPandas(
            _align_group, "host string, hash bigint, wrapper string, pages bigint"
        )
    return materialise(found.drop("hash"), "wrappers")


def extract_pages(pages: DataFrame, key: str, url: str, html: str, wrappers: DataFrame | None = None) -> DataFrame:
    """One row per page: ``key``, ``url``, ``text``, ``wrapper``.

    ``text`` is the article's text, empty if there is none (null and empty pages, pages of menus only). Repeated
    rows and null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    wrappers = infer_wrappers(pages, url, html) if wrappers is None else wrappers

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, found: pd.Series) -> pd.Series:
        slots = {w: article_paths(json.loads(w)) for w in found.unique()}
        return pd.Series([article(h, slots[w]) for h, w in zip(htmls, found)], dtype=object)

    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("_html"), url_host(F.col(url)).alias("host"))
    return rows.join(wrappers.drop("pages"), "host").select(
        key, url, text_of(F.coalesce("_html", F.lit("")), "wrapper").alias("text"), "wrapper"
    )
