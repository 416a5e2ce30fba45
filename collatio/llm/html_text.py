"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line weighs its characters, but nothing inside menus,
headers, footers, sidebars, notices, adverts, forms, reader comments and unseen elements, nothing outside the article
where the page marks one, and only its characters outside links where it marks none. No name and no form makes an
element furniture that holds most of the article or, where none is marked, of the unlinked text; furniture between the
lines of a marked article is cut out with its markup.

Weights are summed over sliding windows of ``window`` lines. Text dives after the last weighty line before a window
without any. What lies between two dives falls into sections, which begin at headings and where a marked article begins;
text surges in the first section with a window of its own that reaches ``surge`` characters (or as many as the largest
window of any section, if less): at its heading or, where it has none, at the first line of that window. Sections right before it
that begin with a heading belong to it, as does all up to the dive. Names of elements and classes only weigh lines; on
every page surge and dive decide what is kept. Windows of 3 lines and a surge of 86 characters are the values that were
published with the method.

Defined results: a null or empty page, and a page without text, give an empty text; broken markup is read as far as it
goes (an unfinished tag or comment at the end is markup); a line break element is white space; character references are
decoded once, unknown ones stay as they are; an element of dropped content (a button, a drawing) that never ends drops nothing
unless it is a script or a style. Whole pages are read, without limits. Repeated rows get equal results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_cores, as_bytes, bounded_batches

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: Elements whose content is dropped. Without an end tag only the first two run to the end of the page.
_RAW = frozenset("script style noscript template svg math iframe object title textarea select button canvas audio video".split())
_ENDLESS = frozenset(("script", "style"))
_FLAT = "button|select"  # cannot hold themselves: the next start tag shows that an end tag is missing


@lru_cache(maxsize=256)
def _token(raw: frozenset[str]) -> re.Pattern:
    return re.compile(
        r"<!--(?:.*?-->|.*\Z)"
        rf"|<(?P<raw>{'|'.join(sorted(raw))})\b(?P<own>{_ATTRS})(?:>.*?(?P<close></(?P=raw)\s*>|(?=<(?:{_FLAT})\b)(?=<(?P=raw)\b)|\Z)|\Z)"
        rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})(?:>|\Z)"
        r"|</?[a-z!?][^>]*(?:>|\Z)",
        re.S | re.I,
    )


_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
_FORMS = frozenset("form fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments disqus respond replies "
    "pagination pager widget legal copyright disclaimer login search toolbar skip tags toc".split()
)
#: Words that may stand beside those in a class or id: site-footer, but not has-sidebar or legal-news.
_NEUTRAL = frozenset(
    "site page main global top bottom left right center inner outer upper lower primary secondary first second area bar bars box block boxes list lists item items link links button buttons icon icons wrap wrapper container "
    "section region slot unit zone panel module component element group row col column content text body title form field input post posts entry article articles story stories news user mobile desktop sticky fixed "
    "js the my id div d s w".split()
)
_COMMENTS = frozenset("comment comments disqus respond replies".split())
_MAIN = frozenset("article main".split())
_MAIN_NAMES = frozenset("articlebody".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true|(?:^|\s)hidden(?=\s|/|$|=\s*[\"']{2})", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Line:
    text: str
    linked: int
    furniture: bool
    main: bool
    heading: bool


def tokens_of(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup of a page: begin, end, tag (None where its content or a comment goes with it), whether it ends an element,
    attributes. An element of dropped content without an end tag is a space, and what follows is read."""
    raw, at = _RAW, 0
    while True:
        for m in _token(raw).finditer(page, at):
            name = (m["raw"] or "").lower()
            if name and name not in _ENDLESS and m["close"] is not None and not m["close"]:
                at = m.end("own") + 1
                if m.end() == len(page):
                    raw = raw - {name}  # no end tag of this kind is left
                yield m.start(), at, "br", False, ""
                break
            tag = m["tag"]
            yield m.start(), m.end(), tag and tag.lower(), bool(m["end"]), m["attrs"] or ""
        else:
            return


def _names(attrs: str) -> tuple[set[str], set[str]]:
    names: set[str] = set()
    roles: set[str] = set()
    for kind, *values in _ATTRIBUTE.findall(attrs):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            roles.add(value.strip().lower())
        else:
            for token in value.split():
                own = {w.lower() for w in _WORD.findall(token)}
                names.add(token.lower())
                if own <= _NAMES | _NEUTRAL:
                    names |= own
    return names, roles


def _kind(tag: str, attrs: str, in_main: bool, spared: bool = False) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it marks the article. spared: a name or a form does not make it furniture."""
    names, roles = _names(attrs) if attrs else (set(), set())
    furniture = tag in _FURNITURE and not (spared and tag in _FORMS) and not (tag == "header" and in_main) or bool(roles & _ROLES) or bool(attrs and _UNSEEN.search(attrs))
    if tag in ("html", "body", "main"):
        furniture = False
    elif tag == "article":
        furniture = furniture or bool(names & _COMMENTS)
    elif tag not in _HEADINGS and tag != "header" and not spared:
        furniture = furniture or bool(names & _NAMES)
    return furniture, not furniture and (tag in _MAIN or "main" in roles or bool(names & _MAIN_NAMES))


def spared_of(page: str) -> frozenset[int]:
    """Begins of the elements that hold more than half of the article or, where none is marked, three quarters of the unlinked text.

    Text counts outside what is furniture for another reason than a name or a form."""
    stack: list[tuple[str, bool, bool, int, int, int]] = []  # tag, furniture, main, begin, unlinked text and text of the article before it
    spans: list[tuple[int, int, int]] = []
    hidden = main = link = text = marked = at = 0

    def leave() -> str:
        nonlocal hidden, main
        tag, f, a, begin, text_before, marked_before = stack.pop()
        hidden -= f
        main -= a
        spans.append((begin, text - text_before, marked - marked_before))
        return tag

    for begin, end, tag, ends, attrs in tokens_of(page):
        if begin > at and not hidden and not link:
            size = len(page[at:begin].strip())
            text += size
            marked += size if main else 0
        at = end
        if tag is None:
            continue
        if tag not in _INLINE:
            link = 0
        elif tag == "a":
            link = 0 if ends else 1
        if ends:
            if any(tag == x[0] for x in stack):
                while stack and leave() != tag:
                    pass
        elif tag not in _VOID and tag not in _INLINE:
            if tag == "p" and stack and stack[-1][0] == "p":
                leave()
            if not attrs.endswith("/"):
                f, a = _kind(tag, attrs, main > 0, True)
                stack.append((tag, f, a, begin, text, marked))
                hidden += f
                main += a
    if at < len(page) and not hidden and not link:
        size = len(page[at:].strip())
        text += size
        marked += size if main else 0
    while stack:
        leave()
    return frozenset(b for b, t, m in spans if (2 * m > marked if marked else 4 * t > 3 * text))


def lines_of(page: str) -> list[Line]:
    """Blocks of a page in order, empty ones left out."""
    spared = spared_of(page)
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, furniture, main
    parts: list[str] = []
    linked = inside_link = 0
    furniture = main = 0
    heading = False

    def flush() -> None:
        nonlocal linked, parts
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, min(linked, len(text)), furniture > 0, main > 0, heading))
        parts, linked = [], 0

    at = 0
    for begin, end, tag, ends, attrs in tokens_of(page):
        if begin > at:
            piece = page[at:begin]
            parts.append(piece)
            if inside_link:
                linked += len(piece.strip())
        at = end
        if tag is None:
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _INLINE:
            if tag == "a":
                inside_link = 0 if ends else 1
            if tag != "span" and tag != "a" or not attrs:
                continue
        if tag not in _INLINE:
            flush()
            inside_link = 0
        if ends:
            if any(tag == t for t, _, _ in stack):
                while stack:
                    open_, f, a = stack.pop()
                    furniture -= f
                    main -= a
                    if open_ == tag:
                        break
            if tag in _HEADINGS:
                heading = False
        elif tag not in _VOID and tag not in _INLINE:
            if tag == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next one begins
                _, f, a = stack.pop()
                furniture -= f
                main -= a
            f, a = _kind(tag, attrs, main > 0, begin in spared)
            if not attrs.endswith("/"):
                stack.append((tag, f, a))
                furniture += f
                main += a
            heading = tag in _HEADINGS
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def weights(lines: list[Line]) -> np.ndarray:
    """Characters of each line that speak for text: none in furniture, none outside an article where one is marked, and
    none in links where none is."""
    marked = any(x.main and not x.furniture for x in lines)
    return np.array([0 if x.furniture or marked and not x.main else len(x.text) if marked else len(x.text) - x.linked for x in lines], np.int64)


def kept_lines(weight: np.ndarray, begins: np.ndarray, window: int, surge: int) -> np.ndarray:
    """Which lines lie between a surge and a dive; ``begins``: lines at which a section of text may begin."""
    ahead = lambda w: np.convolve(w, np.ones(window, np.int64))[window - 1 :] if len(w) else w  # noqa: E731  of each line and those after it
    n, sums = len(weight), ahead(weight)
    runs: list[list[tuple[int, int, np.ndarray]]] = []  # of each run between two dives its sections: begin, end, windows
    i = 0
    while i < n:
        if not weight[i]:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive]:
            dive += 1
        heads = [i, *(j for j in range(i + 1, dive) if begins[j] and weight[j])]
        runs.append([(a, b, ahead(weight[a:b])) for a, b in zip(heads, [*heads[1:], dive])])
        i = dive
    least = min(surge, max((int(own.max()) for run in runs for _, _, own in run), default=0))
    kept = np.zeros(n, bool)
    for run in runs:
        k = next((k for k, (_, _, own) in enumerate(run) if own.max() >= least), None)
        if k is None:
            continue
        first, _, own = run[k]
        if not begins[first]:
            first += int(np.argmax((own >= least) & (weight[first : first + len(own)] > 0)))
        while begins[first] and k and begins[run[k - 1][0]]:  # sections right before it that begin as texts do
            k -= 1
            first = run[k][0]
        kept[first : run[-1][1]] = True
    return kept


def main_text(page: str, window: int = 3, surge: int = 86) -> str:
    lines = lines_of(page)
    lines = [x for x in lines if not (x.furniture and x.main)]  # what stands between the lines of an article parts none of them
    weight = weights(lines)
    marked = any(x.main for x in lines)
    before = [None, *lines]
    begins = np.array([x.heading and not (b and b.heading) or x.main and not (b and b.main) for x, b in zip(lines, before)], bool)
    kept = kept_lines(weight, begins, window, surge)
    return "\n".join(x.text for x, k, w in zip(lines, kept, weight) if k and not x.furniture and (w or not marked))


def extract(pages: DataFrame, page: str = "html", column: str = "main_text", window: int = 3, surge: int = 86) -> DataFrame:
    """pages with a column of main texts; every other column stays as it is."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.array([main_text(raw.decode("utf-8", "replace"), window, surge) for raw in b.to_pylist()], pa.string())

    return all_cores(pages).withColumn(column, F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(as_bytes(F.col(page))))
