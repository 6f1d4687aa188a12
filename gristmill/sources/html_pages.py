"""Article and body text from HTML pages. The parser runs inside partition-parallel Arrow batches."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from gristmill.session import byte_batches

#: Pages whose texts a task holds at a time.
PAGES = 100

# Elements whose content is never article text, and the length limits of the extraction.
NOISE = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "svg", "figure"}
HIDDEN = {"script", "style", "noscript"}
LOOSE_CLASSES = ("article", "story", "body")
PARA_MIN, LOOSE_MIN, TEXT_MIN, TEXT_MAX, LD_MARGIN = 50, 30, 300, 6000, 200
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "ul", "ol", "li", "table", "section", "article", "header", "footer", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "form", "figure", "blockquote", "pre"}


class _Page(HTMLParser):
    """Collects titles, structured data, paragraphs with their articles, and visible text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.og_title = ""
        self.title: list[str] = []
        self.json_ld: list[str] = []
        self.articles: list[int] = []           # paragraph count per article
        self.open_articles: list[int] = []
        self.paras: list[tuple[list[str], tuple[int, ...]]] = []
        self.open_para: list[str] | None = None
        self.loose: list[list[str]] = []        # paragraphs and marked div texts in page order
        self.div_class: list[str] = []
        self.visible: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("property") == "og:title" and not self.og_title:
            self.og_title = (a.get("content") or "").strip()
        if tag in BLOCKS:
            self._close_para()
            self.visible.append("\n")
        elif tag == "br":
            self.visible.append("\n")
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag == "script" and a.get("type") == "application/ld+json":
            self.json_ld.append("")
            self.stack[-1] = "ld+json"
        if tag == "div":
            self.div_class.append(a.get("class") or "")
        if self._noisy():
            return
        if tag == "article":
            self.articles.append(0)
            self.open_articles.append(len(self.articles) - 1)
        elif tag == "p":
            for i in self.open_articles:
                self.articles[i] += 1
            self.open_para = []
            self.paras.append((self.open_para, tuple(self.open_articles)))
            self.loose.append(self.open_para)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._close_para()
            self.visible.append("\n")
        name = "ld+json" if tag == "script" and "ld+json" in self.stack else tag
        if name not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if top == "div":
                self.div_class.pop()
            if top == "article" and self.open_articles and not self._noisy():
                self.open_articles.pop()
            if top == name:
                break

    def handle_data(self, data):
        if "ld+json" in self.stack:
            self.json_ld[-1] += data
            return
        if "title" in self.stack and "head" in self.stack or self.stack[-1:] == ["title"]:
            self.title.append(data)
            return
        if not any(t in HIDDEN for t in self.stack) and "head" not in self.stack:
            self.visible.append(data)
        if self._noisy():
            return
        if self.open_para is not None:
            self.open_para.append(data)
        elif self.stack[-1:] == ["div"] and any(k in self.div_class[-1] for k in LOOSE_CLASSES):
            self.loose.append([data])

    def _close_para(self):
        if "p" in self.stack:
            at = len(self.stack) - 1 - self.stack[::-1].index("p")
            if not any(t in ("article", "div", "section", "li", "td") for t in self.stack[at:]):
                del self.stack[at:]
        self.open_para = None

    def _noisy(self) -> bool:
        return any(t in NOISE or t == "ld+json" for t in self.stack)


def _flat(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def _article_body(blocks: list[str]) -> str:
    """Longest ``articleBody`` in any structured-data block."""
    best = ""
    for raw in blocks:
        try:
            todo = [json.loads(raw.strip())]
        except ValueError:
            continue
        while todo:
            v = todo.pop()
            if isinstance(v, dict):
                body = v.get("articleBody")
                if isinstance(body, str) and len(body) > len(best):
                    best = body
                todo.extend(v.values())
            elif isinstance(v, list):
                todo.extend(v)
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]*>", "", html.unescape(best))).strip()


def parse_page(markup: str | None, text_max: int | None = TEXT_MAX) -> tuple[str, str | None, str]:
    """(title, article text or None when under the minimum, body text); the article is cut at ``text_max`` if that is given."""
    page = _Page()
    page.feed(markup or "")
    page.close()
    title = page.og_title or _flat(page.title)
    best = max(range(len(page.articles)), key=lambda i: (page.articles[i], -i), default=None)
    if best is not None and page.articles[best] == 0:
        best = None
    texts = [_flat(t) for t, inside in page.paras if best is None or best in inside]
    text = "\n".join(t for t in texts if len(t) >= PARA_MIN)
    body = _article_body(page.json_ld)
    if len(body) > len(text) + LD_MARGIN:
        text = body
    if len(text) < TEXT_MIN:
        loose = "\n".join(dict.fromkeys(t for t in map(_flat, page.loose) if len(t) >= LOOSE_MIN))
        text = max(text, loose, key=len)
    seen = re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(page.visible))).strip()
    return title, (text[:text_max] if len(text) >= TEXT_MIN else None), seen


def read_pages(pages: DataFrame, key: str = "page_id", markup: str = "html", text_max: int | None = None) -> DataFrame:
    """(key, title, article_text, article_length, body_text) per page; pages without an article keep a null text."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PAGES):
                pdf = batch.iloc[at:at + PAGES]
                got = [parse_page(m, text_max) for m in pdf[markup]]
                yield pd.DataFrame({
                    key: pdf[key].array, "title": [g[0] for g in got], "article_text": [g[1] for g in got],
                    "article_length": pd.array([len(g[1]) if g[1] else None for g in got], dtype="Int64"), "body_text": [g[2] for g in got]})

    byte_batches(pages.sparkSession)
    return pages.select(key, markup).mapInPandas(run, f"{key} {kind}, title string, article_text string, article_length bigint, body_text string")


def html_article_text(pages: DataFrame) -> DataFrame:
    return read_pages(pages).filter("article_text is not null").select("page_id", "title", "article_text", "article_length")


def html_body_text(pages: DataFrame) -> DataFrame:
    return read_pages(pages).select("page_id", "body_text")
