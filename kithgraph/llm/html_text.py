"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. What is in a container that the result must leave out (menus,
headers, notices and so on) goes. The first pass decides the others, in an article container or not:
blocks that are mostly links are bad, headings excepted; long ones with a natural share of stop words are
good; long ones with hardly any are bad, or open in an article. Where a page's long blocks as a whole have
no stop words, its language is none of those listed, and long blocks without links are good. In the second
pass open blocks take the label of the nearest decided neighbour, in an article of those in the same article
only. At equal distance good wins in an article, bad outside; an article that decides nothing is good.

Defined results: null and empty html and pages without good blocks give an empty text; broken
markup is read as far as it goes (an unclosed comment or script hides the rest); repeated rows are
rows each; an empty table gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table

#: Characters from which a block is judged by its own stop words, and the shares that decide.
LONG, STOP_GOOD, STOP_BAD, LINKS_BAD = 80, 0.18, 0.05, 0.5
# fixed values: element names of HTML, and frequent function words
BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template svg iframe object head select textarea button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD = frozenset("nav header footer aside form menu dialog".split())
GOOD = frozenset("article main".split())
HINT = re.compile(r"(^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|legal|masthead|menu|nav\w*|newsletter|notices?|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)($|[\s_-])", re.I)
STOP = frozenset("the of and to in a is that it for on with as was by this be are from or an at de la le les et des un une en que est dans pour du au der die und das ist den von zu mit nicht für auf ein eine dem el los las y por con para no se su del al una".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]|=)*+)>|<[!?][^>]*>", re.S)
#: A slash that ends an unquoted value closes nothing.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Paragraphs and the like end when the next block begins.
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())


def blocks(page: str) -> list[tuple[str, int, str, int, bool]]:
    """(text, characters in links, "bad", "good" or "" by container, number of the article, whether it is a heading) in page order."""
    out: list[tuple[str, int, str, int, bool]] = []
    articles = 0
    stack: list[tuple[str, str]] = []  # (element, mark)
    marks = {"bad": 0, "good": 0, "hidden": 0, "a": 0}
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            where = "bad" if marks["bad"] else "good" if marks["good"] else ""
            out.append((text, linked, where, articles if where == "good" else 0, any(x in _HEADING for x, _ in stack)))
        parts.clear()
        linked = 0

    def close(at: int) -> None:
        for _, mark in stack[at:]:
            if mark:
                marks[mark] -= 1
        del stack[at:]

    at = 0
    while at <= len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not marks["hidden"]:
            parts.append(piece)
            if marks["a"]:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCK:
            flush()
        elif name == "br" and not marks["hidden"]:
            parts.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in BLOCK and stack and stack[-1][0] in CLOSED_BY_BLOCK:
            close(len(stack) - 1)
        if name in VOID or name not in RAW and _CLOSED.search(m[3]):
            continue
        hints = " ".join(x.strip("\"'") for x in _ATTR.findall(m[3]))
        inside = marks["good"]
        if name in HIDDEN:
            mark = "hidden"
        elif name == "a":
            mark = "a"
        elif name in BAD and not (name == "header" and inside) or hints and name not in ("body", "html") and HINT.search(hints):
            mark = "bad"
        else:
            mark = "good" if name in GOOD else ""
        if mark:
            articles += mark == "good" and not inside
            marks[mark] += 1
        stack.append((name, mark))
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name != "title" or not end:
                at = end.start() if end else len(page)
    flush()
    return out


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP for w in words) / len(words)


def first_pass(found: list[tuple[str, int, str, int, bool]]) -> list[bool | None]:
    """Good, bad or open by container, links, length and stop words."""
    long = [t for t, linked, where, _, _ in found if where != "bad" and len(t) >= LONG and linked <= LINKS_BAD * len(t)]
    known = bool(long) and stop_share(" ".join(long)) >= STOP_BAD
    labels: list[bool | None] = []
    for text, linked, where, _, heading in found:
        if where == "bad":
            labels.append(False)
        elif linked > LINKS_BAD * len(text):
            labels.append(None if heading else False)
        elif len(text) < LONG:
            labels.append(None)
        else:
            share = stop_share(text) if known else 1.0
            labels.append(True if share >= STOP_GOOD else None if share >= STOP_BAD or where else False)
    return labels


def nearest(labels: list[bool | None]) -> list[tuple[int, bool] | None]:
    """For each place the decided label at or before it, with its distance."""
    out: list[tuple[int, bool] | None] = []
    last = None
    for i, x in enumerate(labels):
        last = (i, x) if x is not None else last
        out.append(None if last is None else (i - last[0], last[1]))
    return out


def second_pass(labels: list[bool | None], article: bool) -> list[bool]:
    """Open places take the label of the nearest decided one."""
    out = []
    for a, b in zip(nearest(labels), reversed(nearest(labels[::-1]))):
        if a is None or b is None or a[0] != b[0]:
            best = min((x for x in (a, b) if x is not None), default=None)
            out.append(article if best is None else best[1])
        else:
            out.append(a[1] or b[1] if article else a[1] and b[1])
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    labels = first_pass(found)
    good = second_pass(labels, False)
    for k in {x[3] for x in found} - {0}:
        places = [i for i, x in enumerate(found) if x[3] == k]
        for i, x in zip(places, second_pass([labels[i] for i in places], True)):
            good[i] = x
    return "\n".join(x[0] for x, keep in zip(found, good) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "html", 4 << 20):
                text = [main_text(x or "") for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_html_text": op7_html_text}
SQL: dict[str, str] = {}
