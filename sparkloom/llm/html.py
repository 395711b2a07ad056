"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block element) and the text lengths of
WINDOW lines from each line on are summed. A run of windows with text surges
where the sum rises from 0 and dives where it falls back to 0; runs of which the
peak reaches the threshold are kept. The threshold is SURGE_CHARS or, on a page
of short lines, the page's own peak. Lines of menus, page headers, footers,
sidebars, notices, adverts, forms and comments, lines that mostly link
elsewhere, and, where the page marks its article, all lines outside it, count as
having no text: lengths alone can't tell a short paragraph from a long advert.

Names of classes, ids and roles are a hint that text outweighs: an element that
holds the page's heading and most of its text is no boilerplate whatever it is
called, and if nothing is left, the names are ignored.

Null and empty pages give an empty text; rows keep their multiplicity, equal
ones their own results; markup that never closes is read as text or, for scripts
and comments, dropped with the rest of the page. Pages of any length are read
whole; an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks

WINDOW = 3
#: Characters in a window that make a surge; where no window has as many, the fullest ones do.
SURGE_CHARS = 60

_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template|svg|iframe|textarea|select|button|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = frozenset("nav footer aside form menu dialog".split())
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments respond replies disqus login signup search pagination pager toolbar complementary contentinfo".split()
)


def _listed(attributes: str) -> bool:
    """Whether a class, id or role has a word that boilerplate is called by."""
    return any(not _WORDS.isdisjoint(re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())) for m in _MARKED.finditer(attributes))


def lines(page: str, names: bool = True) -> list[tuple[str, int]]:
    """The page's lines of text, each with the length that the distribution counts for it."""
    page = _GONE.sub("", page)
    tags = [(m.start(), m.end(), bool(m[1]), m[2].lower(), m[3]) for m in _TAG.finditer(page)]
    ends: dict[int, int] = {}  # of each tag that closes, where it does
    open_: dict[str, list[int]] = {}
    before, headings = [0], [0]  # characters and main headings before each tag
    at = 0
    for k, (start, end, closing, name, _) in enumerate(tags):
        before.append(before[-1] + start - at)
        headings.append(headings[-1] + (not closing and name == "h1"))
        at = end
        if not closing:
            open_.setdefault(name, []).append(k)
        elif open_.get(name):
            ends[open_[name].pop()] = k
    everything = before[-1] + len(page) - at

    def boilerplate(k: int, name: str, attributes: str, in_article: bool) -> bool:
        if name in _OUTSIDE or name == "header" and not in_article:
            return True
        if not names or not attributes or name in ("body", "html", "article", "main") or in_article and name == "header" or not _listed(attributes):
            return False
        to = ends[k]
        return not (headings[to] > headings[k] and 2 * (before[to + 1] - before[k + 1]) > everything)

    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    links = 0
    skip, skip_name, link, had_article = 0, "", 0, False
    inside = {"article": 0, "main": 0}

    def flush() -> None:
        nonlocal links
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            dull = skip > 0 or not inside["article"] and links * 2 > len(line)
            out.append((line, 0 if dull else len(line), sum(inside.values()) > 0))
        text.clear()
        links = 0

    at = 0
    for k, (start, end, closing, name, attributes) in enumerate(tags):
        if start > at:
            text.append(page[at:start])
            if link:
                links += start - at
        at = end
        if name not in _INLINE:
            flush()
        if name == "a":
            link = 0 if closing else 1
        elif name in inside:
            if not skip:
                inside[name] = max(0, inside[name] + (-1 if closing else k in ends))
                had_article |= inside[name] > 0
        if skip:
            if name == skip_name and name not in _VOID:
                skip += -1 if closing else 1
        elif not closing and name not in _VOID and k in ends and boilerplate(k, name, attributes, sum(inside.values()) > 0):
            if name in _INLINE:
                flush()
            skip, skip_name = 1, name
    if at < len(page):
        text.append(page[at:])
    flush()
    return [(line, n if within or not had_article else 0) for line, n, within in out]


def kept(lengths: list[int]) -> list[bool]:
    """Which lines lie between a surge and a dive."""
    ahead = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    surge = max(1, min(SURGE_CHARS, max(ahead, default=0)))
    out, start = [False] * len(lengths), None
    for i, total in enumerate([*ahead, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            if max(ahead[start:i]) >= surge:
                out[start:i] = [n > 0 for n in lengths[start:i]]
            start = None
    return out


def main_text(page: str | None) -> str:
    """The text between surge and dive points, its lines joined by a space."""
    for names in (True, False):
        found = lines(page or "", names)
        text = " ".join(line for (line, _), keep in zip(found, kept([n for _, n in found])) if keep)
        if text:
            break
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, whole; a map over rows."""
    blocks.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), blocks.strings(text), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
