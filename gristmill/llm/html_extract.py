"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and words. Words score positive and tags negative; the weights are log odds counted on
labelled pages, that is pages whose ``article`` or ``main`` element marks the content. One linear scan finds the
contiguous region with the highest score. Elements that are never content (scripts, styles, menus, forms, page headers
and footers, sidebars, notices, adverts, reader comments) leave the sequence before. A region inside a marked content
element grows to that element, and blocks are kept whole; elsewhere it grows by
the paragraphs that stand beside it in the same section.

The weights come from a bounded sample (``max_pages`` pages, drawn by a hash of the id); the table of counts has one
row for each tag name known here. Every page is then read whole in one scan.

Defined results: a null or blank page and a page without words give the empty text; broken markup is read as far as it
goes; a repeated page gives a repeated row.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import slices, small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|([^<]+|<)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "title", "tr", "ul"}
INLINE = {"a", "abbr", "b", "cite", "code", "em", "i", "img", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NEVER = {"head", "title", "nav", "footer", "aside", "form", "button", "label", "dialog", "menu", "object", "canvas", "audio", "video", "fieldset"}
#: Of these, what may also be wrapped around the whole page.
WRAPPERS = {"form", "fieldset", "object"}
#: Words in class, id and role that name what is not content.
NOT_CONTENT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "comment", "comments",
    "commentlist", "disqus", "replies", "respond", "sidebar", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead",
    "topbar", "toolbar", "widget", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "popular", "search", "copyright", "disclaimer", "contentinfo",
    "complementary"}
CONTENT = {"article", "main"}
#: Words that stand beside those of ``NOT_CONTENT`` in one class without naming a topic.
BESIDE = {
    "area", "article", "articles", "bar", "block", "blog", "bottom", "box", "button", "buttons", "card", "container", "content", "entry", "form", "global", "group", "header", "icons",
    "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "message", "outer", "page", "panel", "post", "posts", "primary", "region", "right", "row", "section",
    "secondary", "site", "slot", "space", "stories", "text", "thread", "title", "top", "unit", "wrap", "wrapper"}
#: Adverts inside the text, which paragraphs are marked as too.
ADVERT = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion"}
#: Elements whose paragraphs are one text.
PARENTS = {"article", "div", "main", "section", "td"}
TEXT_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figcaption", "caption", "dt", "dd", "td", "th", "tr", "li"}
#: What may hold text of an article although its tag is in ``NEVER``: there it is content unless it is named otherwise.
HELD = {"label", "object"}


def _attributes(text: str) -> tuple[set[str], bool, bool, list[list[str]]]:
    """(words of class, id and role, hidden?, marked as content?, the words of each single class, id and role)."""
    names, hidden, content, whole = set(), False, False, []
    for key, value in _ATTRIBUTE.findall(text):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            names.update(re.split(r"[^a-z]+", value))
            whole += [re.findall("[a-z]+", v) for v in value.split()]
            content |= key == "role" and value == "main"
        elif key == "itemprop":
            content |= value == "articlebody"
        else:
            hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    return names, hidden, content, whole


def names_furniture(name: str, names: set[str], whole: list[list[str]], inside: bool) -> bool:
    """Whether an element is named as what is not content.

    Outside marked content any word of a name counts. Inside it a name must consist of such words (``related-posts``, not
    ``share-of-market``), and headings, paragraphs and cells are text unless their name says that they are adverts.
    """
    if name in INLINE:
        return False if inside else bool(names & NOT_CONTENT)
    if not inside:
        return bool(names & NOT_CONTENT) and (name not in TEXT_BLOCKS or any(w and set(w) <= NOT_CONTENT | BESIDE and set(w) & NOT_CONTENT for w in whole))
    return any(set(w) & (ADVERT if name in TEXT_BLOCKS else NOT_CONTENT) and set(w) <= NOT_CONTENT | BESIDE for w in whole)


def tokens(page: str) -> tuple[list[tuple], list[int]]:
    """Tokens ("", text, None) or (name, closing, attributes), and for each opening tag where it closes (else -1)."""
    out, open_at = [], {}
    ends: list[int] = []
    for m in _TOKEN.finditer(page):
        if m[8] is not None:
            out.append(("", m[8], None))
        elif m[3] or m[6]:
            name, closing = (m[3] or m[6]).lower(), (m[2] or m[5]) == "/"
            out.append((name, closing, m[4] or m[7] or ""))
        else:
            continue
        ends.append(-1)
        name, closing, _ = out[-1]
        if name and name not in VOID:
            if closing is True:
                if open_at.get(name):
                    ends[open_at[name].pop()] = len(out) - 1
            else:
                open_at.setdefault(name, []).append(len(out) - 1)
    return out, ends


def content_marks(seq: list[tuple], ends: list[int]) -> list[tuple[int, int]]:
    """Token ranges of the elements that are marked as content."""
    found = []
    for i, (name, closing, attributes) in enumerate(seq):
        if name and closing is False and ends[i] >= 0 and (name in CONTENT or ("=" in attributes and _attributes(attributes)[2])):
            names = _attributes(attributes)[0] if "=" in attributes else set()
            if not names & NOT_CONTENT:
                found.append((i, ends[i]))
    return found


def _any_between(sorted_places: list[int], lo: int, hi: int) -> bool:
    at = bisect_right(sorted_places, lo)
    return at < len(sorted_places) and sorted_places[at] < hi


def without_furniture(seq: list[tuple], ends: list[int], marks: list[tuple[int, int]]) -> list[int]:
    """Positions of the tokens outside elements that are never content."""
    keep, i, depth_end, form_end = [], 0, -1, -1
    starts = {a: b for a, b in marks}
    titles = [k for k, t in enumerate(seq) if t[0] == "h1" and t[1] is False]
    places = sorted(starts)
    words = [0]
    if any(t[0] in WRAPPERS for t in seq):
        words += accumulate(0 if name else len(text.split()) for name, text, _ in seq)
    while i < len(seq):
        name, closing, attributes = seq[i]
        if i in starts:
            depth_end = max(depth_end, starts[i])
        if name and closing is False:
            end, inside = ends[i], i <= depth_end
            drop = name in NEVER or (name == "header" and not inside)
            if name in HELD and inside and i > form_end:
                drop = False
            # a form around the content, or around most of the page, goes on as a block; its controls are dropped one by one
            elif name in WRAPPERS and end >= 0:
                drop = not _any_between(places, i, end) and not _any_between(titles, i, end) and 2 * (words[end] - words[i]) <= words[-1]
                if not drop:
                    form_end = max(form_end, end)
            if not drop and ("=" in attributes or "hidden" in attributes):
                names, hidden, _, whole = _attributes(attributes)
                drop = hidden or names_furniture(name, names, whole, inside and i not in starts) or ("header" in names and not inside and name not in TEXT_BLOCKS)
                # a wrapper named after one of its parts still holds the content
                if drop and (name in WRAPPERS or name not in NEVER) and end >= 0:
                    drop = name not in ("html", "body", "main") and not _any_between(places, i, end) and not _any_between(titles, i, end)
            if drop:
                if name == "p":
                    end = next((k for k in range(i + 1, len(seq)) if seq[k][0] in BLOCKS and seq[k][0] != "br"), len(seq)) - 1
                elif end < 0 and name in ("footer", "head"):
                    end = len(seq) - 1 if name == "footer" else i
                if end > i:
                    i = end + 1
                    continue
        keep.append(i)
        i += 1
    return keep


def widened(seq: list[tuple], ends: list[int], weights: dict[str, float], first: int, last: int) -> tuple[int, int]:
    """The region with the paragraphs that stand beside it in the same section.

    A list of links between two paragraphs can score below both and end the region; paragraphs with a score of their own
    that have the same parent belong to one text.
    """
    parent = -1
    for i in range(first, -1, -1):
        name, closing, _ = seq[i]
        if name in PARENTS and closing is False and ends[i] >= last and i < first + (seq[first][0] in PARENTS):
            parent = i
            break
    if parent < 0 or parent == first and ends[parent] <= last:
        return first, last
    i, end = parent + 1, ends[parent]
    while i < end:
        name, closing, _ = seq[i]
        if name and closing is False and name not in VOID and ends[i] > i:
            if name == "p":
                inner = range(i, ends[i] + 1)
                if sum(weights[kind(seq[k][0])] if seq[k][0] else weights["word"] * len(seq[k][1].split()) for k in inner) > 0:
                    first, last = min(first, i), max(last, ends[i])
            i = ends[i]
        i += 1
    return first, last


def kind(name: str) -> str:
    return name if name in BLOCKS or name in INLINE else "other"


def counts(page: str) -> dict[str, list[int]]:
    """How often each tag name and word stands inside and outside the marked content of a labelled page."""
    seq, ends = tokens(page)
    marks = content_marks(seq, ends)
    out: dict[str, list[int]] = {}
    if not marks:
        return out
    side, inside, last = [], 0, -1
    opens = {a: b for a, b in marks}
    for i in range(len(seq)):
        last = max(last, opens.get(i, -1))
        side.append(i < last and i not in opens)
    for i, (name, closing, _) in enumerate(seq):
        key, n = (kind(name), 1) if name else ("word", len(closing.split()))
        cell = out.setdefault(key, [0, 0])
        cell[0 if side[i] else 1] += n
    return out


#: Prior counts inside and outside content, which also serve pages without any labelled page.
PRIOR = {"word": (20.0, 4.0), "p": (10.0, 2.0), "br": (4.0, 2.0), "a": (2.0, 40.0), "li": (2.0, 10.0), "ul": (2.0, 10.0)}


def weights_of(seen: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log odds, positive for words and negative for tags."""
    out = {}
    for key in {"word", "other", *BLOCKS, *INLINE}:
        a, b = PRIOR.get(key, (2.0, 4.0))
        n_in, n_out = seen.get(key, (0.0, 0.0))
        odds = math.log((n_in + a) / (n_out + b))
        out[key] = min(3.0, max(0.1, odds)) if key == "word" else max(-4.0, min(-0.05, odds))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the contiguous run with the highest sum, the first of equals; (0, 0) if nothing is positive."""
    best, top, total, start = (0, 0), 0.0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > top:
            top, best = total, (start, i + 1)
    return best


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    seq, ends = tokens(page)
    marks = content_marks(seq, ends)
    keep = without_furniture(seq, ends, marks)
    scores = [weights[kind(seq[i][0])] if seq[i][0] else weights["word"] * len(seq[i][1].split()) for i in keep]
    lo, hi = best_region(scores)
    if lo == hi:
        return ""
    first, last = keep[lo], keep[hi - 1]
    around = [(a, b) for a, b in marks if a <= first and last <= b]
    if around:
        first, last = min(a for a, _ in around), max(b for _, b in around)
    else:
        first, last = widened(seq, ends, weights, first, last)
    blocks, part, wanted = [], [], False

    def close() -> None:
        nonlocal part, wanted
        text = " ".join(entities.unescape("".join(part)).split()) if wanted else ""
        if text:
            blocks.append(text)
        part, wanted = [], False

    for i in keep:
        name, text, _ = seq[i]
        if name in BLOCKS:
            close()
        elif not name:
            part.append(text)
            wanted |= first <= i <= last
    close()
    return "\n".join(blocks)


def fit(pages: DataFrame, max_pages: int = 2000) -> dict[str, float]:
    """Weights from at most about ``max_pages`` labelled pages of ``pages(page_id, html)``."""
    small_batches(pages.sparkSession)
    marked = pages.select("page_id", "html").filter(F.lower("html").rlike(r"<article|<main|articlebody|role=.?main"))
    total = marked.count()
    if not total:
        return weights_of({})
    draw = F.pmod(F.xxhash64("page_id", F.lit("sample")), F.lit(1 << 40))
    sample = marked.filter(draw < int((1 << 40) * min(1.0, max_pages / total)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict[str, list[int]] = {}
            for page in batch["html"]:
                for key, (a, b) in counts(page).items():
                    cell = rows.setdefault(key, [0, 0])
                    cell[0] += a
                    cell[1] += b
            yield pd.DataFrame([(k, float(a), float(b)) for k, (a, b) in rows.items()], columns=["token", "inside", "outside"])

    found = sample.mapInPandas(run, "token string, inside double, outside double").groupBy("token").agg(F.sum("inside"), F.sum("outside"))
    return weights_of({r[0]: (r[1], r[2]) for r in found.collect()})


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html)``."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, "html"):
                yield pd.DataFrame({"page_id": pdf["page_id"].array, "url": pdf["url"].array, "text": [main_text(p, weights) for p in pdf["html"]]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
