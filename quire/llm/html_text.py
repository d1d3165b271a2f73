"""Main text of web pages by the line-block distribution.

A page becomes lines: one for each block of text, empty ones for blocks that markup names as boilerplate. The
lengths of the lines are summed over sliding windows; the main text begins where the sums surge, with the short lines right
before that, ends where they dive to nothing, and all lines between stay, short ones too. An article element only adds weight
to its lines. What names say is evidence of two kinds: remarks of readers, notices and adverts never are the article, however
long; names of layout (side bars, headers, widgets) count unless their element holds an article or a main heading, or
nothing else on the page surges. Tags are read once from left to right. Pages are independent rows: no shuffle.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.worker import blocks

#: Lines in a window; window sum at which text surges; share of the page's largest sum that is enough on short pages.
WINDOW, SURGE, SURGE_SHARE = 3, 86, 0.5
#: How many times the characters of an article or main element count.
ARTICLE_WEIGHT = 2

RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp")
DROP = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "menu",
}
VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track"}
#: Whole class tokens, ids and roles of boilerplate: a word of it, by itself or with words of layout around it. First what
#: readers say, notices and adverts, then what in a class or role, but not in an id, is what readers say; last layout.
_BEFORE = r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|sub|post|entry|article|user|users|reader|readers|cookie|guest)[-_])*"
_AFTER = (
    r"(?:[-_]?\d+|[-_](?:bar|box|lists?|items?|links?|buttons?|btn|icons?|slot|unit|container|wrapper|wrap|block|section|"
    r"area|banner|widgets?|posts?|articles?|stories|form|nav|menu|inner|top|bottom|left|right|thread|threads|notice|signup|body|text|content|author|meta|header|footer|title|policy|message))*"
)
NEVER = re.compile(
    _BEFORE + r"(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo|comments?|disqus|reply|replies|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup)" + _AFTER, re.I
)
SAID = re.compile(_BEFORE + r"(?:discussions?|responses?|reviews?|guestbook)" + _AFTER, re.I)
LAYOUT = re.compile(
    _BEFORE + r"(?:banner|side-?bar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|social|share|sharing|related|recommended|widgets?|toolbar|pagination|contentinfo|complementary|search)"
    r"(?:[-_]?\d+|[-_](?:bar|box|lists?|items?|links?|buttons?|btn|icons?|slot|unit|container|wrapper|wrap|block|section|area|banner|widgets?|posts?|articles?|stories|form|nav|menu|inner|top|bottom|left|right|thread))*",
    re.I,
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose end tag may be left out: what ends them when it starts, and what they can't reach out of.
IMPLIED = {
    "li": (("li",), {"ul", "ol", "menu"}),
    "dd": (("dd", "dt"), {"dl"}),
    "dt": (("dd", "dt"), {"dl"}),
    "td": (("td", "th"), {"tr", "table"}),
    "th": (("td", "th"), {"tr", "table"}),
    "tr": (("tr",), {"table"}),
}
NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
#: What ends a tag or begins a quoted value.
STOP = re.compile(r">|=\s*[\"']")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of what is no text, in order; no name for comments, raw
    elements and declarations. Every character is passed once: a tag whose quotes never end ends at its first ">", and from
    there on quotes no longer count; one without ">" is text, and so is what follows."""
    at, quotes, size = 0, True, len(page)

    def tag_end(i: int) -> int:
        nonlocal quotes
        k = i
        while quotes:
            m = STOP.search(page, k)
            if m and page[m.start()] == ">":
                return m.end()
            k = page.find(page[m.end() - 1], m.end()) + 1 if m else 0
            quotes = k > 0
        return page.find(">", i) + 1

    while (i := page.find("<", at)) >= 0:
        close = page.startswith("/", i + 1)
        name = NAME.match(page, i + 1 + close)
        if page.startswith("<!--", i):
            at = page.find("-->", i + 4) + 3
            yield i, (at := at if at > 2 else size), None, False, ""
        elif name:
            end = page.find(">", i) + 1 if close else tag_end(name.end())
            if not end:
                return
            at, word = end, name[0].lower()
            if word in RAW_END and not close:
                m = RAW_END[word].search(page, end)
                at = m.end() if m else size
                yield i, at, None, False, ""
            else:
                yield i, at, word, close, page[name.end() : end - 1]
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            if not (end := page.find(">", i) + 1):
                return
            at = end
            yield i, at, None, False, ""
        else:
            at = i + 1


def named_boilerplate(name: str, attrs: str) -> int:
    """Do the class, id or role of a tag name boilerplate? 2: never the article; 1: layout. Ids of headings are anchors."""
    found = 0
    for key, a, b, c in ATTR.findall(attrs) if "=" in attrs else ():
        key = key.lower()
        if key in ("class", "role") or key == "id" and name not in HEADINGS:
            for x in (a or b or c).split():
                if NEVER.fullmatch(x) or key != "id" and SAID.fullmatch(x):
                    return 2
                found |= bool(LAYOUT.fullmatch(x))
    return found


def page_lines(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(text of a block, or "" for a dropped one; whether it stands in an article; mostly links?; in layout?) in page order."""
    out: list[tuple[str, bool, bool, int]] = []
    piece: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements: name, what it is named for, its region of layout or the one around
    where: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by name, and of all blocks
    block: list[int] = []
    parent, holds = [0], [True]  # of regions of layout: the one around, and whether there is an article or main heading
    region = dropping = never = linked = 0

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(piece)).split())
        piece.clear()
        if text:
            out.append(("" if never else text, bool(where["article"] or where["main"]), 2 * linked > len(text), region))
        linked = 0

    def pop() -> None:
        nonlocal dropping, never, region
        name, kind, around = stack[-1]
        if name in BLOCK or name in DROP or kind:
            end_line()
        stack.pop()
        where[name].pop()
        if name in BLOCK:
            block.pop()
        dropping -= name in DROP
        never -= kind == 2
        region = around

    def end(names: tuple[str, ...], bounds: set[str]) -> None:
        """End the innermost open element of ``names``, with what is open in it."""
        last = lambda ns: max((where[n][-1] for n in ns if where[n]), default=-1)
        k = last(names)
        if k > ((block[-1] if block else -1) if bounds is BLOCK else last(bounds)):
            while len(stack) > k:
                pop()

    at = 0
    for start, stop, name, close, attrs in tags(page):
        if not dropping and start > at:
            piece.append(page[at:start])
            linked += bool(where["a"]) * (start - at)
        at = stop
        if name is None:
            continue
        if name == "br":
            piece.append(" ")
            continue
        if close:
            if name in BLOCK:
                end_line()
            # A cell or item that is left open ends with its list or table; an inline end tag does not reach out of a block.
            end((name,), set() if name in BLOCK or name in DROP else BLOCK)
            continue
        if name in BLOCK or name in DROP:
            end(("p",), {"table", "td", "th", "caption", "button", "object"})
            if name in IMPLIED:
                end(*IMPLIED[name])
            end_line()
        if name == "a":
            end(("a",), BLOCK)
        if name in VOID or name in ("html", "body") or attrs.endswith("/"):
            continue
        kind, around = 0 if dropping else named_boilerplate(name, attrs), region
        if kind:
            end_line()
        if name in ("h1", "article", "main") and not kind and not never and not dropping:
            holds[region] = True
        if kind == 1:
            parent.append(region)
            holds.append(False)
            region = len(parent) - 1
        stack.append((name, kind, around))
        where[name].append(len(stack) - 1)
        if name in BLOCK:
            block.append(len(stack) - 1)
        dropping += name in DROP
        never += kind == 2
    if not dropping and at < len(page):
        piece.append(page[at:])
    end_line()
    for r in range(len(parent) - 1, 0, -1):
        holds[parent[r]] |= holds[r]
    layout = [False]
    for r in range(1, len(parent)):
        layout.append(layout[parent[r]] or not holds[r])
    return [(text, inside, links, layout[r]) for text, inside, links, r in out]


def _surges(sizes: list[int]) -> tuple[list[int], float]:
    """Sums of the windows that begin at each line, and the sum at which text surges."""
    at = [0, *accumulate(sizes)]
    sums = [at[min(i + WINDOW, len(sizes))] - at[i] for i in range(len(sizes))]
    return sums, max(1.0, min(SURGE, SURGE_SHARE * max(sums, default=0)))


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by one line feed; "" where there is none.

    Mostly linked lines outside of an article, and lines of boilerplate, are empty lines. Text begins where a window's
    sum surges, with the lines right before that, and goes on until the windows dive to nothing; where it surges again
    there is more of it. Lines of an article weigh ARTICLE_WEIGHT times as much. Lines of layout are text only where no
    other line's window reaches SURGE.
    """
    found = page_lines(page)
    weigh = lambda texts: [len(t) * (ARTICLE_WEIGHT if inside else 1) for t, (_, inside, _, _) in zip(texts, found, strict=True)]
    texts = ["" if links and not inside else text for text, inside, links, _ in found]
    plain = ["" if layout else t for t, (*_, layout) in zip(texts, found, strict=True)]
    if max(_surges(weigh(plain))[0], default=0) >= SURGE or not any(texts):
        texts = plain
    sums, least = _surges(weigh(texts))
    kept, before, flowing = [], [], False
    for text, x in zip(texts, sums, strict=True):
        flowing = x >= least or flowing and x > 0
        if flowing:
            kept += [t for t in (*before, text) if t]
        before = [*before, text] if text and not flowing else []
    return "\n".join(kept)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``text`` (string) and ``n_chars`` (long, its code points) for every row.

    Null and empty html give the text "" and 0. Whole pages are read whatever their length; repeated rows stay;
    other columns are left behind, also such as are named like the results.
    """
    passed = [c for c in dict.fromkeys([id_col, *keep]) if c not in ("text", "n_chars")]
    rows = df.select(*dict.fromkeys([*passed, html_col]))
    schema = T.StructType([rows.schema[c] for c in passed] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in blocks(whole, html_col)):
            texts = [main_text(p) if p else "" for p in b.column(html_col).to_pylist()]
            arrays = [b.column(c) for c in passed] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*passed, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
