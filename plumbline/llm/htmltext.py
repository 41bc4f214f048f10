"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags.  Blocks inside menus, page
headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles are out: by element, or by the words in ``class``, ``id`` and ``role``,
which are cut at hyphens, underscores and capitals.
If the page marks articles or its main part, only the blocks inside count; of
several articles those that are short and have a linked heading are teasers of
other pages and out, unless all are.  The
first pass labels each block by its link density, its length and its stop-word
density, and leaves short ones open; in the second pass an open block takes the
label of its nearest decided neighbours, and a heading that of the block that
it heads.  Stop words speak only where the page as a whole has enough of one
language's: elsewhere length and link density decide, and a long block is never
out for its words alone.  The thresholds of the density are low
because the lists of stop words hold only the few dozen commonest of each
language.  One article on the page is a prior: few stop words leave its blocks
open, and an open one is out only between blocks that are out.

Broken markup never fails: unclosed quotes, tags, comments and elements end at
the next tag or with the page.  Defined cases: a null or empty page has an
empty text; equal rows give equal rows; only page_id, url and html are read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.text import bound_batches, sliced

LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.2, 70, 200, 0.10, 0.18
#: Characters, links aside, below which an article with a linked heading is a teaser.
TEASER = 400

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    frozenset(words.split())
    for words in (
        "a an the of and to in is that it for on was with be by this are from or not at as but what have has had he she they we you i",
        "der die das und in zu den ist von mit für auf ein eine im dem nicht des sich auch als er es an werden aus bei sie wie oder",
        "le la les de des et un une en est que qui dans pour sur au aux du par pas ne il elle ce se avec son sa ou plus",
        "el la los las de del y en una un que es con por su al lo como para se no más o pero sus si ya",
    )
]
# Elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
OUT = frozenset("nav footer aside form menu dialog button select svg canvas object audio video map datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPEN_ENDED = frozenset("p li dt dd option tr td th".split())
HINTS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions promoted banner banners cookie cookies consent gdpr
    notice notices alert alerts menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer footers masthead comment comments disqus reply replies
    share sharing social related recommend recommended recommendation recommendations newsletter newsletters subscribe signup login search popup modal widget widgets toolbar pagination pager""".split()
)
HEAD_HINTS = frozenset("header headers topbar".split())
#: Words that turn the hint behind them around, and those that make a header part of the text.
_WITHOUT, _OF_TEXT = frozenset("has with no without".split()), frozenset("article content entry post story".split())
_EDGE = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_TAG = re.compile(r"""<(?:!--|[!?][^>]*>?|(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"<]*"|'[^'<]*')*+>|[^<>]*+>?))""")
_MARK = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.I | re.A)


@lru_cache(1 << 16)
def _hints(token: str) -> tuple[bool, bool]:
    """Does a class word name a part that is out, and one that is out before an article?"""
    parts = [p.lower() for p in _EDGE.split(token)]
    if not _WITHOUT.isdisjoint(parts):
        parts = parts[: min(k for k, p in enumerate(parts) if p in _WITHOUT)]
    return not HINTS.isdisjoint(parts), not HEAD_HINTS.isdisjoint(parts) and _OF_TEXT.isdisjoint(parts)


def unwanted(tag: str, marks: str, inside: bool) -> bool:
    """Is an element out, by its tag and attributes? inside: an article that is already open."""
    if tag in OUT or tag == "header" and not inside:
        return True
    if "=" not in marks or tag in ("html", "body", "main"):
        return False
    for name, value in _MARK.findall(marks):
        for token in value.strip("\"'").split():
            if name.lower() == "role":
                if token.lower() in _ROLES and tag != "article":
                    return True
            elif len(token) <= 100:
                hint, head = _hints(token)
                if hint or head and not inside and tag != "article":
                    return True
    return False


class Block:
    """Characters of one block; ``group``: number of the article around it, 0 for none; ``main``: inside the main part."""

    __slots__ = ("parts", "linked", "group", "main", "heading", "text")

    def __init__(self, group: int, main: bool, heading: bool):
        self.parts, self.linked, self.group, self.main, self.heading, self.text = [], 0, group, main, heading, ""


def blocks(html: str) -> list[Block]:
    """The blocks with text that are not out, in page order."""
    found: list[Block] = []
    never: set[str] = set()  # elements that no end tag closes from here on
    at, articles, groups, main, link, heading = 0, 0, 0, 0, 0, False
    skip, depth = "", 0
    now = Block(0, False, False)

    def close() -> None:
        nonlocal now
        now.text = " ".join(unescape("".join(now.parts)).split())
        if now.text:
            found.append(now)
        now = Block(groups if articles else 0, main > 0, heading)

    def closing_at(tag: str) -> int:
        m = None if tag in never else _closing(tag).search(html, at)
        if not m:
            never.add(tag)
        return m.start() if m else -1

    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        if not m:
            if not skip:
                now.parts.append(html[at:])
            break
        if m.start() > at and not skip:
            piece = html[at : m.start()]
            now.parts.append(piece)
            if link:
                now.linked += len(piece)
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                stop = html.find("-->", at)
                at = end if stop < 0 else stop + 3
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if tag in RAW:
            if not closing and not m[3].endswith("/>"):
                stop = closing_at(tag)
                if stop < 0:
                    at = end if tag in ("script", "style") else at
                else:
                    more = html.find(">", stop)
                    at = end if more < 0 else more + 1
            continue
        if skip:
            if tag == skip:
                depth += -1 if closing else 0 if skip in OPEN_ENDED else 1
                if depth <= 0 or skip in OPEN_ENDED:
                    skip = ""
                    if not closing:
                        at = m.start()
                continue
            if not (skip in OPEN_ENDED and tag in BLOCKS and tag != "br" or tag in ("article", "main") and not closing and closing_at(skip) < 0):
                continue
            skip = ""
        if not closing and tag not in VOID and not m[3].endswith("/>") and unwanted(tag, m[3], articles > 0):
            close()
            skip, depth = tag, 1
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag in BLOCKS:
            if tag == "article":
                if not closing and not articles:
                    groups += 1
                articles = max(0, articles + (-1 if closing else 1))
            elif tag == "main":
                main = max(0, main + (-1 if closing else 1))
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            close()
    close()
    return found


def stop_words(found: list[Block]) -> frozenset[str]:
    """The list of the page's language; an empty one if the page has few of any."""
    tokens = [t.strip(".,;:!?()\"'") for b in found for t in b.text.lower().split()]
    counts = Counter(tokens)
    best = max(STOP_WORDS, key=lambda words: sum(counts[w] for w in words))
    return best if sum(counts[w] for w in best) >= FEW_STOPS * max(1, len(tokens)) else frozenset()


def first_pass(b: Block, stops: frozenset[str], prior: bool = False) -> str:
    """good, bad or open; stops: the page's stop words, none if they say nothing; prior: the block is in the page's only article."""
    if b.linked > LINKS * len(b.text):
        return "bad"
    if len(b.text) < SHORT or b.heading:
        return "open"
    long = len(b.text) > LONG
    if not stops:
        return "good" if long else "open"
    tokens = b.text.lower().split()
    share = sum(t.strip(".,;:!?()\"'") in stops for t in tokens) / len(tokens)
    if share >= MANY_STOPS:
        return "good"
    if share >= FEW_STOPS:
        return "good" if long else "open"
    return "open" if prior or long else "bad"


def teasers(found: list[Block]) -> set[int]:
    """The articles, by group, that are short and have a linked heading; none if all are."""
    size: Counter[int] = Counter()
    linked: set[int] = set()
    for b in found:
        size[b.group] += max(0, len(b.text) - b.linked)
        if b.heading and b.linked > LINKS * len(b.text):
            linked.add(b.group)
    short = {g for g in linked if size[g] < TEASER}
    return short if len(short) < len(size) else set()


def second_pass(found: list[Block], labels: list[str], prior: bool = False) -> list[bool]:
    """Open blocks inherit; ties go to the block's own leaning: a heading or a longer block is text, with a prior any block."""
    n, before, after = len(found), [], [None] * len(found)
    last = None
    for i in range(n):
        before.append(last)
        last = i if labels[i] != "open" else last
    last = None
    for i in reversed(range(n)):
        after[i] = last
        last = i if labels[i] != "open" else last
    out = []
    for i in range(n):
        if labels[i] != "open":
            out.append(labels[i] == "good")
            continue
        p, q = before[i], after[i]
        if prior:
            near = [labels[k] for k in (p, q) if k is not None]
            out.append(not near or "good" in near)
            continue
        if found[i].heading and q is not None:
            out.append(labels[q] == "good")
        elif p is None and q is None:
            out.append(True)
        elif p is None or q is None or labels[p] == labels[q]:
            out.append(labels[q if p is None else p] == "good")
        elif i - p != q - i:
            out.append(labels[p if i - p < q - i else q] == "good")
        else:
            out.append(len(found[i].text) >= SHORT)
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    found = blocks(html or "")
    if any(b.group for b in found):
        found = [b for b in found if b.group]
        out = teasers(found)
        found = [b for b in found if b.group not in out]
    elif any(b.main for b in found):
        found = [b for b in found if b.main]
    prior = len({b.group for b in found} | {0}) == 2
    stops = stop_words(found)
    kept = second_pass(found, [first_pass(b, stops, prior) for b in found], prior)
    return " ".join(b.text for b, k in zip(found, kept) if k)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    bound_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(_pages, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
