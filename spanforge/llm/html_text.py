"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of the page becomes one line with a
length: the characters it adds to an article. Menus, headers, footers, asides,
notices, adverts, forms, comments of readers, scripts and the like, as tags,
roles or class names say, add none: each such part is one line of length 0, as
is a line that is mostly links. Lines of an ``<article>`` or ``<main>`` and
headings get ``least`` characters on top, which is evidence, no decision.

Over sliding windows of ``width`` lines the lengths are summed. A surge, where
a window comes to ``least`` characters, opens a run at its first line that has
so many, and the dive to a window of 0 closes it. No window crosses the border
of an article. The run with the most text decides which article it is: the runs
of the same article element belong to it or, on a page that marks none, the
runs and the single paragraphs of the same parent element.

Defined results for odd input
    Null, empty or textless html gives the empty text and 0 characters. Pages
    cut off in a tag or in a reference are read as browsers do: the open tag is
    dropped, the reference stays as written if it has no end and no name that
    may do without. A quote that is never closed ends at the next ``>``. Very
    long pages are read whole, in time linear in their length. Of runs that tie
    the first is taken. Repeated rows each come back; an empty table gives no
    rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .tables import read

#: Elements that are not part of an article, ones that end a line, ones without an end.
OUTSIDE = frozenset("nav footer aside form button select dialog menu noscript iframe svg object template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, elements of the head, elements that hold prose.
RAW = frozenset("script style template textarea title svg iframe noscript".split())
HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "blockquote", "pre", "dd", "figcaption"}
#: Elements of which a link may be all and still be of the article.
LINKED = PROSE | {"td", "th"}
#: Elements that the same element ends when it follows inside it.
ALIKE = frozenset("p li dd dt tr td th option".split())
#: Class and id names of parts that are not the article, words that may stand beside them in a name, and roles.
PARTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo promotion related replies respond share sharing sidebar social sponsor sponsored subscribe widget widgets".split())
BESIDE = frozenset("area articles bar block bottom box buttons container content foot global group header holder icons inner item items left links list main media page panel posts primary right secondary section sidebar signup site slot stories thread top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>\"'<]*)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.I) for tag in RAW}
LABEL = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[\s_-]+")


@dataclass
class Line:
    text: str
    links: int  # characters in links
    article: int  # number of the innermost article or main element, 0 outside
    parent: int  # number of the element that holds the block
    tag: str


def _part(name: str) -> bool:
    """Whether one class name or id, as ``site-footer`` or ``comments``, names a part outside of the article."""
    words = [w for w in WORDS.split(name.lower()) if w]
    return any(w in PARTS for w in words) and all(w in PARTS or w in BESIDE or w.isdigit() for w in words)


def _outside(tag: str, attributes: str) -> bool:
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in LABEL.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES) or (name in ("class", "id") and any(map(_part, value.split()))):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, "") for text and ("open" or "close", tag, attributes) in page order."""
    at, start, quotes = 0, 0, True
    endless: set[str] = set()  # elements that nothing closes from here on
    while (i := page.find("<", at)) >= 0:
        two = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
            name = None
        elif two in ("!", "?"):
            cdata = page.startswith("<![CDATA[", i)
            end = page.find("]]>" if cdata else ">", i)
            end = len(page) if end < 0 else end + (3 if cdata else 1)
            name = None
        elif name := NAME.match(page, i):
            rest = REST.match(page, name.end()) if quotes else None
            if rest is None:
                # After a quote without an end, here or before, quotes count for nothing.
                quotes, end = False, page.find(">", name.end()) + 1
                end = end or len(page)
            else:
                end = rest.end()
        else:
            at = i + 1
            continue
        if i > start:
            yield "", page[start:i], ""
        at = start = end
        if name:
            tag = name[1].lower()
            yield "close" if two == "/" else "open", tag, page[name.end() : end - 1]
            if tag in RAW and two != "/":
                closed = None if tag in endless else CLOSE[tag].search(page, end)
                if closed:
                    at = start = closed.end()
                    yield "close", tag, ""
                elif tag in ("script", "style", "textarea", "title"):
                    return
                else:
                    endless.add(tag)
    if start < len(page):
        yield "", page[start:], ""


def lines_of(page: str) -> list[Line | None]:
    """The blocks of the page in order; None for a part that is not of the article."""
    out: list[Line | None] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # tag, outside, article, number
    opened: Counter[str] = Counter()
    inside: dict[int, int] = {}  # article or main: the one around it
    links = anchors = elements = 0
    gone = head = False

    def end() -> None:
        nonlocal links, gone
        text = SPACE.sub(" ", "".join(parts)).strip()
        tag, outside, article, number = stack[-1]
        if text:
            out.append(Line(text, links, article, stack[-2][3] if tag in PROSE or tag == "li" else number, tag))
        if gone and not text and (not out or out[-1] is not None):
            out.append(None)
        parts.clear()
        links, gone = 0, False

    for kind, tag, attributes in tokens(page):
        if not kind:
            if stack[-1][1]:
                gone = gone or not tag.isspace()
            elif not head:
                parts.append(piece := html.unescape(tag))
                links += len(piece) * (anchors > 0)
            continue
        head = (head or tag == "head") and tag in HEAD | {"head"} and not (tag == "head" and kind == "close")
        if tag in BLOCKS:
            end()
        if tag == "a":
            anchors = int(kind == "open")
        if tag in VOID or tag in ("head", "title", "style", "script", "textarea"):
            continue
        if kind == "open":
            top = stack[-1]
            if (top[0] == "p" and tag in BLOCKS) or (tag in ALIKE and top[0] == tag):
                opened[stack.pop()[0]] -= 1
                top = stack[-1]
            if attributes.endswith("/") and tag not in BLOCKS:
                continue
            # The header of an article holds its title, other headers are of the site.
            outside = top[1] or _outside(tag, attributes) or (tag == "header" and not top[2])
            article = top[2]
            elements += 1
            if tag in ("article", "main") and not outside:
                article, inside[elements] = elements, top[2]
            if tag in BLOCKS or outside:
                stack.append((tag, outside, article, elements))
                opened[tag] += 1
        elif opened[tag]:
            while True:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
    end()
    # A main element with one article in it is that article, title and all.
    within = Counter(inside.values())
    for line in out:
        while line and line.article and inside[line.article] and within[inside[line.article]] == 1:
            line.article = inside[line.article]
    return out


def runs_of(sizes: list[int], width: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of each stretch from a surge of the window sums to their dive."""
    out, start, total = [], -1, sum(sizes[:width])
    for i in range(len(sizes)):
        if start < 0 and total >= least:
            start = i
        elif start >= 0 and total == 0:
            out.append((start, i))
            start = -1
        total += (sizes[i + width] if i + width < len(sizes) else 0) - sizes[i]
    return [*out, (start, len(sizes))] if start >= 0 else out


def main_text(page: str | None, width: int = 3, least: int = 40) -> str:
    """The article of ``page``, its blocks joined by one space."""
    lines = lines_of(page) if page else []

    def size(line: Line | None) -> int:
        if line is None or (line.links > 0.5 * len(line.text) and line.tag not in LINKED):
            return 0
        return len(line.text) + least * (line.article > 0) + least * (line.tag in HEADINGS)

    sizes = list(map(size, lines))
    if not any(sizes):
        return ""
    home = [line.article if line else -1 for line in lines]
    kept: list[list[int]] = []  # the lines of each run that have text
    begin = 0
    for i in range(1, len(lines) + 1):
        # What is outside of the article breaks no stretch; another article does.
        if i == len(lines) or (home[i] >= 0 and home[begin] >= 0 and home[i] != home[begin]):
            for a, b in runs_of(sizes[begin:i], width, least):
                run = [j for j in range(begin + a, begin + b) if sizes[j]]
                while run and sizes[run[0]] < least and lines[run[0]].tag not in PROSE:
                    run.pop(0)
                while run and not lines[run[-1]].article and (lines[run[-1]].tag in HEADINGS or (sizes[run[-1]] < least and lines[run[-1]].tag not in PROSE and lines[run[-1]].tag != "li")):
                    run.pop()
                if run:
                    kept.append(run)
            begin = i
        elif home[begin] < 0:
            begin = i if i < len(lines) else begin
    if not kept:
        return " ".join(line.text for line, n in zip(lines, sizes) if n)
    best = max(kept, key=lambda run: sum(sizes[j] for j in run))
    article = home[best[0]]
    if article:
        take = {j for run in kept for j in run if home[j] == article}
    else:
        weight: Counter[int] = Counter()
        for j in best:
            weight[lines[j].parent] += sizes[j]
        parent = weight.most_common(1)[0][0]
        take = set(best) | {j for run in kept if 2 * sum(sizes[j] for j in run if lines[j].parent == parent) > sum(sizes[j] for j in run) for j in run}
        take |= {j for j, line in enumerate(lines) if sizes[j] and line.parent == parent and line.tag in PROSE - HEADINGS}
    return " ".join(lines[j].text for j in sorted(take))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(batches, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
