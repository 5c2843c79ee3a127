"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, functions as F

#: Lines per sliding window.
WINDOW = 3
#: A stretch of text lines is kept when some window of it reaches this many characters, or half of the page's fullest window.
PEAK = 86
#: A character inside an article or main element counts so many times.
BODY_WEIGHT = 2

# Element names of the markup language, by role.
UNSEEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "title", "audio", "video")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav menu header footer aside form button dialog fieldset label head".split())
BODY = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words in class and id names that mark what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer bottombar sidebar sidebars aside widget widgets related recommended recommendations cookie cookies consent gdpr notice notices alert popup modal overlay "
    "subscribe subscription newsletter signup login share sharing social comment comments commentlist disqus respond reply replies discussion form search copyright".split()
)

_START = re.compile(r"<!--|<(" + "|".join(UNSEEN) + r")\b|<[!?]", re.I)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in UNSEEN}
_TAG = re.compile(r"</?[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_EDGE = re.compile(r"[<>]")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


def _is_furniture(name: str, attributes: str, in_body: bool, by_name: bool) -> bool:
    if name in FURNITURE and not (name == "header" and in_body):
        return True
    if not by_name or name in ("html", "body", "main"):
        return False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            parts = {p.lower() for p in _PARTS.findall(value)}
            if parts & NAMES and not (name == "article" and not parts & {"comment", "comments", "reply"}):
                return True
        if key == "aria-hidden" and value.lower() == "true" or key == "hidden":
            return True
    return False


class _Closers:
    """Where a tag ends: the first ``>`` outside quotes from a place that is outside quotes, -1 without one.

    The answers for all places are found in one pass from the end of the page, so that pages of
    unclosed tags or quotes take no more time than others.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in re.finditer("[\"'>]", page)]
        self.ends = [-1] * (len(self.places) + 1)
        after = {'"': None, "'": None}
        for k in range(len(self.places) - 1, -1, -1):
            mark = page[self.places[k]]
            if mark == ">":
                self.ends[k] = self.places[k]
            else:
                # a quote opens here; behind its partner the tag goes on
                self.ends[k] = -1 if after[mark] is None else self.ends[after[mark] + 1]
                after[mark] = k

    def __call__(self, at: int) -> int:
        return self.ends[bisect_left(self.places, at)]


def visible(page: str) -> str:
    """The page without comments, declarations and the elements that hold no text for readers; one space stands for each."""
    closer, last, out, kept, at = _Closers(page), page.rfind(">"), [], 0, 0
    while start := _START.search(page, at):
        if start[0] == "<!--":
            end = page.find("-->", start.end())
            end = len(page) if end < 0 else end + 3
        elif start[1]:
            end = closer(start.end())
            if end >= 0:
                found = _END[start[1].lower()].search(page, end + 1)
                end = found.end() if found else len(page)
        else:
            end = page.find(">", start.end()) + 1 if start.end() <= last else -1
        if end < 0:
            at = start.start() + 1
            continue
        out += [page[kept : start.start()], " "]
        kept = at = end
    return "".join([*out, page[kept:]])


def tags(page: str):
    """``start, end, closing, name, attributes`` of every tag; the name is empty where a tag is not closed properly."""
    closer, at, name_end = _Closers(page), 0, -1
    while start := _TAG.search(page, at):
        closing = page[start.start() + 1] == "/"
        first = start.end() - 1
        if name_end <= first:
            found = _NAME_END.search(page, first)
            name_end = found.start() if found else len(page)
        end = closer(name_end)
        if end >= 0:
            yield start.start(), end + 1, closing, page[first:name_end].lower(), page[name_end:end]
            at = end + 1
            continue
        edge = _EDGE.search(page, first)
        if edge and edge[0] == "<":
            at = edge.start()
            continue
        at = edge.end() if edge else len(page)
        yield start.start(), at, closing, "", ""


def lines_of(page: str, by_name: bool = True) -> list[tuple[str, int, bool, bool]]:
    """The page's blocks in order: text, characters outside links, whether it is furniture, whether an article holds it."""
    page = visible(page)
    lines: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    linked = [0]
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def flush() -> None:
        joined = re.sub(r"\s+", " ", "".join(text)).strip()
        if joined:
            lines.append((joined, max(len(joined) - linked[0], 0), *state()))
        text.clear()
        linked[0] = 0

    def add(raw: str) -> None:
        if raw:
            shown = html.unescape(raw)
            text.append(shown)
            if opened["a"]:
                linked[0] += len(shown.strip())

    def close(name: str) -> None:
        """Close the innermost open element of a name and all inside it."""
        while opened[name]:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                break

    at = 0
    for start, end, closing, name, attributes in tags(page):
        add(page[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            close(name)
        elif name not in VOID and not attributes.endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                close(name)
            off, body = state()
            off = off or _is_furniture(name, attributes, body, by_name)
            stack.append((name, off, (body or name in BODY) and not off))
            opened[name] += 1
    add(page[at:])
    flush()
    return lines


def between_surges(lengths: list[int], peak: int = PEAK, window: int = WINDOW) -> list[bool]:
    """Which lines lie between a surge and the next dive of the sliding text lengths.

    A surge starts at the first line with text after an empty window, the dive is the last line with
    text before one; a stretch counts when its fullest window reaches ``peak`` or half the page's maximum.
    """
    sums = [sum(lengths[max(0, i - window + 1) : i + 1]) for i in range(len(lengths))]
    full = max(sums, default=0)
    keep = [False] * len(lengths)
    start = None
    for i in range(len(lengths) + 1):
        if i < len(lengths) and sums[i] > 0:
            start = i if start is None else start
        elif start is not None:
            if max(sums[start:i]) >= min(peak, full / 2):
                last = max(j for j in range(start, i) if lengths[j] > 0)
                keep[start : last + 1] = [True] * (last + 1 - start)
            start = None
    return keep


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty, and pages without text outside furniture.

    Furniture (menus, headers, footers, asides, forms, adverts, notices, comments, by element, role,
    or name) counts as lines without text. On every page the distribution decides which of the other
    lines stay; characters inside an article or main element weigh ``BODY_WEIGHT`` times as much.
    Where it leaves nothing (all text is links), the lines of the article or main element stay. A
    page that a wrongly nested name would empty is read again by element names alone.
    """
    for by_name in (True, False):
        lines = lines_of(page or "", by_name)
        lengths = [0 if off else outside * (BODY_WEIGHT if body else 1) for _, outside, off, body in lines]
        kept = [k and not line[2] for k, line in zip(between_surges(lengths), lines, strict=True)]
        if not any(kept):
            kept = [body and not off for _, _, off, body in lines]
        if any(kept):
            return " ".join(line[0] for line, k in zip(lines, kept, strict=True) if k)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``; the rest is ignored).

    Pages are read whole; the time of a page is in proportion to its length, whatever its markup.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
