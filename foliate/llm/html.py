"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one a block). Text lengths are summed over a sliding window of lines; windows over a share
of the greatest sum form the body, from a surge to a dive. The body is widened to the element that holds its ends, and to
the <article> or <main> around a dense line, so that a heading before the surge or short closing lines after the dive stay.
"""

from __future__ import annotations

import html as _html
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string"
WINDOW = 3
#: Share of the greatest window sum from which a window belongs to the body.
SURGE = 0.25
#: Nested wrappers that are opened if nothing else is left of a page.
WRAPPERS = 8

# Element names and the words in class, id or role that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROP = frozenset("head nav header footer aside form script style textarea title noscript iframe xmp noembed noframes template svg math canvas object audio video button select option menu dialog label fieldset figure".split()) - {"figure"}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img nobr picture".split())
IMPLIED = frozenset("p li dt dd tr td th option".split())
HOLDERS = frozenset("html body main article div section td th center".split())
MAIN = frozenset("article main".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidenav rail nav navbar navigation menu topbar breadcrumb breadcrumbs "
    "header masthead footer foot comment comments commentlist reply replies disqus respond cookie cookies consent gdpr notice notices notification alert popup popover modal overlay dialog newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager copyright legal disclaimer search form toolbar complementary contentinfo".split()
)
TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", regex.S)
ATTRIBUTE = regex.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", regex.I)
PART = regex.compile(r"[A-Za-z]+")
HIDDEN = regex.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", regex.I)


@dataclass
class Line:
    text: str
    holder: int
    main: int
    linked: int = 0


def noisy(name: str, attributes: str) -> bool:
    if not attributes or name in ("html", "body", "main", "article"):
        if name != "article" or not attributes:
            return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" and name not in INLINE:
            return True
        if key == "style":
            if HIDDEN.search(value):
                return True
        elif key in ("class", "id", "role"):
            parts = {w.lower() for w in PART.findall(value)}
            if name == "article":
                parts &= {"comment", "comments", "reply", "ad", "advert", "sponsored", "related"}
            if parts & NOISE:
                return True
    return False


def wrapper(name: str, attributes: str) -> bool:
    """Whether an element that would be dropped may hold a whole page: a form, or one with other words in its class or id."""
    words = {w.lower() for k, v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id") for w in PART.findall(v)}
    return name == "form" or name not in DROP and bool(words - NOISE) and not HIDDEN.search(attributes)


def strip(source: str) -> list[Line]:
    """The lines that markup does not already rule out, with the elements that hold them.

    If none is left, the dropped wrapper with most text is opened, and so on, WRAPPERS times at most.
    """
    opened: set[int] = set()
    for _ in range(WRAPPERS + 1):
        lines, dropped = _strip(source, opened)
        if lines or not dropped:
            break
        opened.add(max(dropped, key=lambda k: (dropped[k], -k)))
    return lines


def _strip(source: str, opened: set[int]) -> tuple[list[Line], dict[int, int]]:
    """Lines, and characters of text in each dropped wrapper, by where it begins. Those in opened are not dropped."""
    lines: list[Line] = []
    text: list[str] = []
    linked = at = skip_depth = 0
    skip, begin = "", -1
    dropped: dict[int, int] = {}
    holders, holder_names, next_id = [0], [""], 1
    inside: Counter[str] = Counter()  # names in holder_names
    mains: list[int] = [0]
    links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                lines.append(Line(line, holders[-1], mains[-1], linked))
            text.clear()
        linked = 0

    n, search = len(source), TAG.search
    while at < n:
        tag = search(source, at)
        end = tag.start() if tag else n
        if not skip and end > at:
            text.append(source[at:end])
            if links:
                linked += end - at
        elif skip and begin in dropped:
            dropped[begin] += len(source[at:end].strip())
        if not tag:
            break
        at = tag.end()
        name = tag[2].lower() if tag[2] else ""
        if not name or not tag[4]:
            continue
        closing, own = bool(tag[1]), tag[3].endswith("/")
        if name in RAW and not closing:
            close = regex.compile(rf"</{name}(?=[\s/>]|\Z)", regex.I).search(source, at)
            if not skip and name not in DROP:
                text.append(source[at : close.start() if close else n])
            at = close.end() if close else n
            tail = source.find(">", at)
            at = n if tail < 0 else tail + 1
            continue
        if skip in IMPLIED and not closing and (name == skip or skip == "p" and name not in INLINE and name not in VOID):
            skip, skip_depth = "", 0  # its end tag was left out
        if skip:
            if name == skip:
                skip_depth += -1 if closing else 0 if name in VOID else 1
                if not skip_depth:
                    skip = ""
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif not closing and name not in VOID and noisy(name, tag[3]):
                skip, skip_depth = name, 1
            continue
        if name == "br":
            text.append(" ")
            continue
        flush()
        if closing:
            while inside[name]:
                last = holder_names.pop()
                inside[last] -= 1
                holders.pop()
                mains.pop()
                if last == name:
                    break
            continue
        if name in VOID:
            continue
        if tag.start() not in opened and (name in DROP or noisy(name, tag[3])):
            begin = tag.start()
            if wrapper(name, tag[3]):
                dropped[begin] = 0
            if not own or name not in ("svg", "math"):
                skip, skip_depth = name, 1
            continue
        if name in HOLDERS:
            holders.append(next_id)
            holder_names.append(name)
            inside[name] += 1
            mains.append(next_id if name in MAIN else mains[-1])
            next_id += 1
    flush()
    return lines, dropped


def body(lines: list[Line], window: int = WINDOW, surge: float = SURGE) -> list[Line]:
    """The lines from each surge to its dive, widened to what holds them.

    Dense lines are sought over the whole page. An <article> or <main> only adds: all its lines stay if one is dense. It
    then lends no weight to lines outside it, which have to be dense by themselves. Between dense lines outside such
    elements all lines stay.
    """
    if not lines:
        return []
    weights, half = [max(0, len(x.text) - x.linked) for x in lines], window // 2

    def density(w: list[int]) -> list[int]:
        return [sum(w[max(0, i - half) : i + half + 1]) for i in range(len(w))]

    sums = density(weights)
    least = max(1, surge * max(sums))
    found = {x.main for x, s, w in zip(lines, sums, weights) if x.main and s >= least and w}
    rest = density([0 if x.main in found else w for x, w in zip(lines, weights)])
    dense = [i for i, x in enumerate(lines) if weights[i] and (sums if x.main in found else rest)[i] >= least]
    kept = [x.main in found for x in lines]
    for a, b in zip(dense, dense[1:]):
        if lines[a].main not in found and lines[b].main not in found:
            kept[a : b + 1] = [True] * (b + 1 - a)
    for i in dense:
        kept[i] = True
        for step in (-1, 1) if lines[i].main not in found else ():
            j = i + step
            while 0 <= j < len(lines) and lines[j].holder == lines[i].holder and not kept[j]:
                kept[j] = True
                j += step
    return [x for x, k in zip(lines, kept) if k]


def main_text(source: str | None) -> str:
    return "\n".join(x.text for x in body(strip(source or "")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html.

    Null or empty html, or a page without text, gives an empty text. Unclosed tags end with what follows them, and a tag
    or comment cut off at the end is dropped. Repeated rows stay; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), texts], names=["page_id", "url", "text"])

    return pages.select(id_col, url_col, html_col).mapInArrow(rows, SCHEMA)
