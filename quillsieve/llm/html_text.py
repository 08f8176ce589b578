"""HTML extraction by the maximum-scoring subsequence of a page's words and tags.

A page becomes a list of tags and text nodes. Words score what labelled pages say of words in such
a place, tags score below zero, and one linear scan finds the contiguous region with the largest
sum. The region is widened to the article or container that it lies in; what stands in menus, side
bars, notices, adverts, forms, scripts or reader comments is left out of it. Elements whose names
speak against them go or stay by a logistic fit to labelled elements: parts of their names, links,
words, headings and form controls in them.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import table

# A tag whose quoted values may hold ">", or, if a quote stays open, whatever comes up to the next ">".
_NODE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'<]++|\"[^\"<]*\"|'[^'<]*')*+)(?:>|(?=<|\Z)|[^>]*(?:>|\Z))", re.S
)
_CLASS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Elements whose text is never read, elements of the page's frame, elements that begin and end blocks.
RAW = frozenset("script style noscript template iframe object svg math textarea title select option canvas audio video".split())
FRAME = frozenset("nav footer aside form menu dialog button label fieldset header head".split())
BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 div section article main ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr address details summary body html nav footer aside form menu dialog header center".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
HOLDERS = (BLOCK | FRAME) - VOID - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "body", "html"}
#: Parts of class names and ids that name what isn't the article.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidenav nav navbar navigation breadcrumb breadcrumbs crumbs footer masthead topbar comment comments commentlist disqus replies reply respond share sharing related recommended recommendations widget widgets toolbar pagination pager login skip".split()
)
#: Parts that may as well be what a section of an article is about.
WEAK = frozenset("menu header discussion social search".split())
#: Parts that say in what form something stands.
FORM = frozenset("icons icon buttons button form label labels links link list item items card cards cta trail previous prev next posts post articles article stories".split())
#: Parts that say where it stands or whose it is, which tells nothing.
PLACE = frozenset("box bar block area section container wrapper wrap holder inner outer info law policy author user reader site page main global top bottom left right upper lower content text unit slot primary secondary mobile desktop js c u l wp id the new".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_PREFIX = frozenset("no has with without not is".split())
#: Elements of one line or paragraph, which end at their end tag or where the next block begins.
FLAT = frozenset("p span li h1 h2 h3 h4 h5 h6".split())

WORD_PLACES = ("block", "heading", "link", "frame", "bare")
TAG_KINDS = ("a", "li", "p", "h", "div", "br", "inline", "frame", "article", "other")


def evidence(name: str, attributes: str) -> tuple | None:
    """What an element's attributes say against it: True if it is hidden or has such a role, else features of its names; None if nothing."""
    if name in ("body", "html", "article", "main") or not attributes:
        return None
    best = None
    for m in _CLASS.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return (True,)
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return (True,)
        if key in ("class", "id"):
            for one in value.split():
                parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", one).lower()) if x]
                strong, weak = STRONG.intersection(parts), WEAK.intersection(parts)
                if parts[:1] and parts[0] not in _PREFIX and (strong or weak):
                    rest = [x for x in parts if x not in STRONG and x not in WEAK]
                    found = (False, bool(strong), bool(weak), any(x in FORM for x in rest), any(x not in FORM and x not in PLACE for x in rest), key == "id" or name in FLAT and not strong, frozenset(strong | weak))
                    best = max(best or found, found, key=lambda f: (f[1], not f[4], f[3], not f[5]))
    return best


def features(said: tuple, words: int, linked: int, heads: str, controls: int) -> list[float]:
    """An element's features: those of its names, its link density, its words outside links, whether a heading in it says its name, controls of forms."""
    _, strong, weak, form, other, anchor, names = said
    titled = bool(names.intersection(re.findall("[a-z]+", heads.lower())))
    free = words - linked
    return [1.0, strong, weak and not strong, form, other, anchor, linked / max(1, words), min(1.0, math.log1p(free) / 4), titled, controls > 0]


def labelled_elements() -> list[tuple[list[float], int]]:
    """Features of elements with 1 for what isn't the article: names as pages use them, about contents of several lengths."""
    out = []
    contents = [(3, 0, 0), (12, 0, 0), (60, 4, 0), (6, 6, 0), (20, 16, 0), (4, 1, 2)]

    def add(name: str, key: str, element: str, words: int, linked: int, controls: int, heads: str, y: int) -> None:
        said = evidence(element, f' {key}="{name}"')
        if said:
            out.append((features(said, words, linked, heads, controls), y))

    for strong in sorted(STRONG):
        for words, linked, controls in contents:
            for name in (strong, f"{strong}-box", f"site-{strong}", f"{strong}-links"):
                add(name, "class", "div", words, linked, controls, "", 1)
            add(strong, "id", "div", words, linked, controls, "", 1)
            # A subject beside the name: the article's own where it is prose.
            add(f"{strong}-history", "class", "div", words, linked, controls, "", int(linked > words / 2 or controls > 0))
        for words in (12, 60, 300):
            add(strong, "id", "section", words, 0, 0, strong, 0)
    for weak in sorted(WEAK):
        for words, linked, controls in contents:
            links = int(linked > words / 2 or controls > 0)
            add(weak, "class", "div", words, linked, controls, "", int(links or words < 4))
            add(f"{weak}-icons", "class", "div", words, linked, controls, "", 1)
            add(f"{weak}-section", "class", "div", words, linked, controls, "", int(links or words < 4))
            add(f"{weak}-history", "class", "div", words, linked, controls, "", links)
            add(weak, "id", "p", words, linked, controls, "", links)
        for words in (3, 12, 60, 300):
            add(weak, "id", "div", words, 0, 0, weak, 0)
    return out


@functools.lru_cache(maxsize=1)
def element_weights() -> tuple[float, ...]:
    """Weights of features() by a logistic fit to the labelled elements: Newton steps with a small ridge."""
    rows = labelled_elements()
    x, y = np.array([f for f, _ in rows], dtype=float), np.array([v for _, v in rows], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
    return tuple(float(v) for v in w)


def _kind(name: str) -> str:
    if name in ("a", "li", "p", "br"):
        return name
    if re.fullmatch("h[1-6]", name):
        return "h"
    if name in ("article", "main"):
        return "article"
    if name in FRAME:
        return "frame"
    if name in ("div", "section", "table", "tr", "td", "ul", "ol"):
        return "div"
    return "inline" if name in ("b", "i", "em", "strong", "span", "u", "small", "code", "sub", "sup", "mark", "q", "cite", "font", "abbr", "time") else "other"


class _Element:
    """An element that may not be the article's: its items run from start to end."""

    __slots__ = ("name", "said", "start", "end", "inside", "sure")

    def __init__(self, name: str, said: tuple | None, start: int, inside: bool, sure: bool):
        self.name, self.said, self.start, self.end, self.inside, self.sure = name, said, start, -1, inside, sure


def nodes(page: str) -> list[tuple]:
    """The page in order: ("text", place, words, text, holder, framed) and ("tag", kind, name, opens, holder, framed).

    holder numbers the innermost container; framed tells whether anything around isn't the article.
    One pass lists tags and texts with the elements that may have to go, a second decides on these
    by what they hold; both take time in proportion to the page.
    """
    items: list[tuple] = []
    stack: list[tuple[str, int, _Element | None]] = []
    suspects: list[_Element] = []
    around: list[_Element] = []
    comments: set[int] = set()
    number, link, heading, block, at = 0, 0, 0, 0, 0
    inside_article = 0
    open_names: Counter = Counter()
    flat, depth = None, 0

    def text(raw: str) -> None:
        said = html.unescape(raw)
        if said:
            place = "link" if link else "heading" if heading else "block" if block or inside_article else "bare"
            items.append(("text", place, len(said.split()), said, stack[-1][1] if stack else 0))

    for m in _NODE.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        opens = not m[1]
        attributes = m[3] or ""
        bare = attributes.rstrip().endswith("/")
        if opens and name in RAW:
            if not bare:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if flat:
            if name == flat.name:
                depth += 1 if opens and name == "span" else -1
            elif flat.name == "li" and name in ("ul", "ol"):
                depth += 1 if opens else -1
            elif flat.name != "li" and name in BLOCK and name != "br":
                depth = 0
            if depth <= 0:
                flat.end, flat = len(items), None
        if name == "a":
            link = int(opens)
        elif re.fullmatch("h[1-6]", name):
            heading = int(opens)
            block = int(opens)
        elif name in ("p", "li", "dd", "dt", "blockquote", "pre", "td", "figcaption"):
            block = int(opens)
            heading = 0
        if name in HOLDERS:
            if opens and not bare:
                number += 1
                said = evidence(name, attributes)
                comment = name == "article" and inside_article > 0 and bool(re.search(r"comment|reply", attributes, re.I))
                one = None
                if comment or said or name in FRAME:
                    one = _Element(name, said, len(items), inside_article > 0, comment)
                    suspects.append(one)
                    if comment:
                        comments.add(len(items))
                if name in ("article", "main"):
                    inside_article += 1
                    # The article's own start ends whatever frame was left open around it.
                    if not comment:
                        for other in around:
                            if other.end < 0:
                                other.end = len(items)
                        around.clear()
                elif name in FRAME:
                    around.append(one)
                stack.append((name, number, one))
                open_names[name] += 1
                link = 0
            elif not opens and open_names[name]:
                while True:
                    n, _, one = stack.pop()
                    open_names[n] -= 1
                    if one and one.end < 0:
                        one.end = len(items)
                    if n in ("article", "main"):
                        inside_article -= 1
                    if n == name:
                        break
                link = heading = block = 0
        elif opens and name in FLAT and not bare and not flat:
            said = evidence(name, attributes)
            if said:
                flat, depth = _Element(name, said, len(items), inside_article > 0, False), 1
                suspects.append(flat)
        items.append(("tag", _kind(name), name, opens, stack[-1][1] if stack else 0))
    if at < len(page):
        text(page[at:])
    return _decided(items, suspects, comments)


def _decided(items: list[tuple], suspects: list[_Element], comments: set[int]) -> list[tuple]:
    """Items with whether they stand in an element that goes."""
    sums = [(0, 0, 0, 0, 0, 0)]
    heads, head_at = [], []
    for i, n in enumerate(items):
        words, linked, articles, titles, lists, controls = sums[-1]
        if n[0] == "text":
            words += n[2]
            linked += n[2] if n[1] == "link" else 0
            if n[1] == "heading":
                heads.append(n[3])
                head_at.append(i)
        elif n[3]:
            articles += n[1] == "article" and i not in comments
            titles += n[2] == "h1"
            lists += n[2] in ("nav", "ul", "form")
            controls += n[2] in ("form", "input", "button", "label", "fieldset")
        sums.append((words, linked, articles, titles, lists, controls))
    weights_of = element_weights() if suspects else ()
    edges = [0] * (len(items) + 1)
    for e in suspects:
        end = e.end if e.end >= 0 else len(items)
        words, linked, articles, titles, lists, controls = (y - x for x, y in zip(sums[min(e.start + 1, len(items))], sums[end], strict=True))
        if e.said and e.said[0]:
            goes = True
        elif e.sure:
            goes = True
        elif articles > 0:  # What holds the article is a wrapper, whatever its name.
            goes = False
        elif e.name in FRAME:
            goes = not (e.name == "header" and (e.inside or titles > 0 and lists == 0))
            goes = goes or e.name == "header" and e.said is not None and e.said[1]
        else:
            first = bisect.bisect_left(head_at, e.start)
            head = heads[first] if first < len(heads) and head_at[first] < end else ""
            goes = sum(w * f for w, f in zip(weights_of, features(e.said, words, linked, head, controls), strict=True)) > 0
        if goes:
            edges[e.start] += 1
            edges[max(end, e.start)] -= 1
    out, frames = [], 0
    for i, n in enumerate(items):
        frames += edges[i]
        out.append((n[0], "frame", *n[2:], True) if frames and n[0] == "text" else (*n, frames > 0))
    return out


def labelled_pages() -> list[tuple[str, int, int]]:
    """(page, start, end): pages spelled out here, with the place of the article in them."""
    words = "the river was long and stone paper made of old light over water where people went to read what they had found in it".split()

    def prose(k: int, n: int) -> str:
        return " ".join(words[(k * 7 + i * (1 + k % 3)) % len(words)] for i in range(n))

    def menu(k: int, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(k + i, 1 + i % 2)}</a></li>' for i in range(n)) + "</ul>"

    out = []
    for k in range(60):
        body = f"<h1>{prose(k, 6)}</h1>" + "".join(f"<p>{'<b>' if i % 3 == 0 else ''}{prose(k + i, 8 + (k * i) % 50)}{'</b>' if i % 3 == 0 else ''}{'<br>' if i % 4 == 1 else ''} {prose(i, 9)} <a href='#'>{prose(i, 2)}</a></p>" for i in range(1 + k % 6))
        if k % 5 == 0:
            body += f"<ul><li>{prose(k, 9)}</li><li>{prose(k + 1, 12)}</li></ul>"
        head = f"<html><head><title>{prose(k, 6)}</title></head><body>"
        before = [f"<nav>{menu(k, 6)}</nav>", f'<header><a href="/">{prose(k, 2)}</a>{menu(k, 4)}</header>', f'<div class="menu">{menu(k, 8)}</div><div class="ad">{prose(k, 7)}</div>', f"<div>{menu(k, 5)}</div>"][k % 4]
        after = [f"<footer>&copy; {prose(k, 5)}</footer>", f'<div class="comments"><p>{prose(k, 9)}</p><p>{prose(k, 5)}</p></div><footer>{menu(k, 3)}</footer>', f"<aside><p>{prose(k, 8)}</p>{menu(k, 4)}</aside>", f"<form><label>{prose(k, 2)}</label></form><div>{menu(k, 6)}</div>"][(k // 4) % 4]
        start, end = [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>")][k % 3]
        page = head + before + start + body + end + after + "</body></html>"
        at = len(head + before)
        out.append((page, at, at + len(start + body + end)))
    return out


@functools.lru_cache(maxsize=1)
def weights() -> dict[tuple[str, str], float]:
    """The score of a word by its place and of a tag by its kind: logarithms of how much likelier it is in the article.

    Words outside links and the page's frame score above zero and tags below, whatever the labelled pages say.
    """
    inner, outer = Counter(), Counter()
    for page, a, b in labelled_pages():
        for part, into in ((page[:a], outer), (page[a:b], inner), (page[b:], outer)):
            for n in nodes(part):
                into[n[0], n[1]] += n[2] if n[0] == "text" else 1
    total_in, total_out = sum(inner.values()) + 20, sum(outer.values()) + 20
    out = {}
    for key in [("text", p) for p in WORD_PLACES] + [("tag", k) for k in TAG_KINDS]:
        ratio = math.log((inner[key] + 1) / total_in) - math.log((outer[key] + 1) / total_out)
        out[key] = min(-0.05, ratio) if key[0] == "tag" or key[1] in ("frame", "link") else max(0.2, ratio)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, by one scan; (0, 0) if no score is above zero. Ties: the first."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def _widened(items: list[tuple], a: int, b: int) -> tuple[int, int]:
    """The region widened to the article or main element that holds most of its words, else within its container."""
    opened, spans = [], []
    for i, n in enumerate(items):
        if n[0] == "tag" and n[1] == "article":
            if n[3]:
                opened.append(i)
            elif opened:
                spans.append((opened.pop(), i + 1))
    spans += [(i, len(items)) for i in opened]
    held = lambda s: sum(n[2] for n in items[max(a, s[0]) : min(b, s[1])] if n[0] == "text" and not n[5])
    free = [s for s in spans if not items[s[0]][5] and held(s)]
    if free:
        most = max(held(s) for s in free)
        return min((s for s in free if held(s) == most), key=lambda s: s[1] - s[0])
    count = Counter()
    for n in items[a:b]:
        if n[0] == "text" and not n[5]:
            count[n[4]] += n[2]
    if not count:
        return a, b
    holder = max(count, key=lambda k: (count[k], -k))
    inside = [i for i, n in enumerate(items) if n[0] == "text" and n[4] == holder and n[2] and n[1] != "frame"]
    if not holder:
        return a, b
    a, b = min([a, *inside]), max([b, *(i + 1 for i in inside)])
    # Headings between the container's start and the region are the article's, though a header holds them.
    start = next((i for i, n in enumerate(items[:a]) if n[0] == "tag" and n[3] and n[4] == holder), a)
    return min([a, *(i for i in range(start, a) if items[i][0] == "text" and items[i][1] == "heading" and not items[i][5])]), b


def main_text(page: str | None) -> str:
    """The article of a page: character references decoded, white space in a block one space, blocks joined by two newlines."""
    if not page:
        return ""
    items = nodes(page)
    score = weights()
    a, b = best_region([score[n[0], n[1]] * (n[2] if n[0] == "text" else 1) for n in items])
    if a == b:
        return ""
    a, b = _widened(items, a, b)
    blocks, now = [], []

    def close() -> None:
        said = " ".join("".join(now).split())
        if said:
            blocks.append(said)
        now.clear()

    for n in items[a:b]:
        if n[0] == "text":
            if not n[5]:
                now.append(n[3])
        elif n[2] in BLOCK:
            close()
        elif n[2] == "br":
            now.append(" ")
    close()
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html); n_chars counts code points.

    Null and empty pages, and pages without an article, give an empty text. Unclosed tags, scripts,
    comments and pages cut short are read as far as they go. Repeated rows appear once each; other
    columns are ignored; an empty table gives no rows. Very long pages are read whole, in time in
    proportion to their length; of regions with equal sums the first is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(said, pa.string()), pa.array([len(t) for t in said], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8(spark, sf_dir) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
