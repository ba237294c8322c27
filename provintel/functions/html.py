"""HTML views as Arrow-vectorized functions over the standard library's parser.

page_view() reads a page once and gives all the parts that are asked for, so builders that share a table of pages share
one Python pass; visible_text() and the others are page views of one part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, sentences

PAGE_DROPS = ("script", "style", "nav", "footer", "header")
ARTICLE_DROPS = (*PAGE_DROPS, "aside", "form", "noscript")
NAME_TAGS = ("h3", "h4", "strong", "b")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LINKS = "array<struct<href: string, text: string>>"
POSTINGS = "array<struct<id: string, title: string>>"
VENDOR_ROWS = "array<struct<name: string, purpose: string, location: string>>"


class _Walker(HTMLParser):
    """Text outside dropped tags, links with their text, headings and meta contents, table / list rows."""

    def __init__(self, drops: tuple[str, ...] = PAGE_DROPS, inside: tuple[str, ...] = (), cards: tuple[str, ...] = (), card_tags: tuple[str, ...] = ("div", "a")):
        super().__init__(convert_charrefs=True)
        self.drops, self.inside, self.card_words, self.card_tags = drops, inside, cards, card_tags
        self.cards: list[dict] = []
        self.open_cards: list[tuple[int, dict]] = []  # depth and card
        self.hidden = self.within = 0
        self.text: list[str] = []
        self.main: list[str] = []
        self.links: list[tuple[str, list[str]]] = []
        self.open_link = False
        self.named: dict[str, list[str]] = {}
        self.stack: list[str] = []
        self.tables: list[list[list[list[str]]]] = []
        self.terms: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (a.get("name") or a.get("property") or "").lower()
            if key == "description" or key.startswith("og:"):
                self.named.setdefault("meta", []).append(a.get("content", ""))
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag in self.card_tags and any(w in a.get("class", "") for w in self.card_words):
            self.cards.append({"tag": tag, "class": a.get("class", ""), "texts": [], "name": None, "naming": 0})
            self.open_cards.append((len(self.stack), self.cards[-1]))
        if tag in NAME_TAGS:
            for _, card in self.open_cards:
                if card["name"] is None:
                    card["name"], card["naming"] = [], len(self.stack)
        self.hidden += tag in self.drops
        self.within += tag in self.inside or a.get("role") == "main"
        if tag == "a":
            self.links.append((a.get("href", ""), []))
            self.open_link = True
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append([])
        elif tag in ("dt", "dd"):
            self.terms.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            last = self.stack.pop()
            for _, card in self.open_cards:
                card["naming"] *= card["naming"] <= len(self.stack)
            self.open_cards = [c for c in self.open_cards if c[0] <= len(self.stack)]
            self.hidden -= last in self.drops and self.hidden > 0
            self.within -= last in self.inside and self.within > 0
            if last == "a":
                self.open_link = False
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else ""
        if top in ("title", "h1", "h2"):
            self.named.setdefault(top, []).append(data)
        if self.open_link and self.links:
            self.links[-1][1].append(data)
        if self.tables and self.tables[-1] and self.tables[-1][-1] and "tr" in self.stack:
            self.tables[-1][-1][-1].append(data)
        for _, card in self.open_cards:
            card["texts"].append(data)
            if card["naming"]:
                card["name"].append(data)
        if self.terms and ("dt" in self.stack or "dd" in self.stack):
            self.terms[-1][1].append(data)
        if not self.hidden:
            self.text.append(data)
            if self.within:
                self.main.append(data)


def _walk(html: str | None, **how) -> _Walker:
    w = _Walker(**how)
    w.feed(html or "")
    w.close()
    return w


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_MARK = "\ud800"  # half a surrogate pair, which no string of a table holds


def _ended_text(html: str) -> str:
    """Visible text where a reference counts only up to its semicolon: `&amp` without one stays as it stands, while HTML reads it as `&`."""
    marked = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else _MARK + m[0][1:], html)
    return squeeze(_walk(marked).text).replace(_MARK, "&")


def squeeze(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _mapped(kind: str, fn: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action=None)

    return run


# Words that make a page one of subprocessors, its columns, and the classes of its cards and of result cards.
SUBPROCESSOR_TERMS = ("subprocessor", "sub-processor", "data processor")
SUBPROCESSOR_NAMES = ("amazon", "google", "microsoft", "azure", "openai", "anthropic")
VENDOR_COLUMNS = {
    "name": ("company", "name", "vendor", "processor", "provider"), "purpose": ("purpose", "service", "description", "use", "category"), "location": ("location", "country", "region", "jurisdiction"),
}
VENDOR_CARDS = ("card", "item", "processor", "vendor")
RESULT_CARDS = {"AWS": ("card", "result", "case-study", "customer-reference"), "GCP": ("card", "result", "customer", "tile"), "Azure": ("card", "result", "story", "customer")}


def _table_rows(table: list[list[list[str]]]) -> list[dict]:
    rows = [[squeeze(c) for c in r] for r in table]
    head = [c.lower() for c in rows[0]] if len(rows) > 1 else []
    at = {k: next((i for i, c in enumerate(head) if any(w in c for w in words)), None) for k, words in VENDOR_COLUMNS.items()}
    if at["name"] is None:
        return []
    cell = lambda r, i: r[i] if i is not None and i < len(r) else ""
    return [{k: cell(r, i) for k, i in at.items()} for r in rows[1:] if cell(r, at["name"])]


def _card_rows(cards: list[dict]) -> list[dict]:
    found = []
    for card in cards:
        name, text = squeeze(card["name"] or []), " | ".join(t for x in card["texts"] if (t := squeeze([x])))
        if len(name) > 2:
            found.append({"name": name, "purpose": text.replace(name, "").strip(" |"), "location": ""})
    return found


def _term_rows(terms: list[tuple[str, list[str]]]) -> list[dict]:
    names, told = ([squeeze(x) for t, x in terms if t == tag] for tag in ("dt", "dd"))
    return [{"name": n, "purpose": p, "location": ""} for n, p in zip(names, told, strict=False) if n]


def _job_descriptions(html: str) -> Iterator[str]:
    """Descriptions that some job boards embed as JSON; what isn't JSON after all is left out."""
    if m := re.search(r'"descriptionPlainText"\s*:\s*("(?:[^"\\]|\\.)*")', html):
        try:
            yield json.loads(m[1], strict=False)
        except ValueError:
            pass
    if m := re.search(r'<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', html, re.DOTALL):
        try:
            stack = [json.loads(m[1])]
        except ValueError:
            stack = []
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if isinstance(x.get("currentJob"), dict):
                    yield squeeze(_walk(x["currentJob"].get("description") or "").text)
                stack.extend(x.values())
            elif isinstance(x, list):
                stack.extend(x)


def _embedded_list(html: str) -> list[dict]:
    """Postings with an id of the job list that a board's page assigns to its app data; a list that isn't whole gives none.

    The decoder reads one value from the first brace on, so braces inside descriptions don't end it.
    """
    at = html.find("window.__appData")
    begin = html.find("{", at) if at >= 0 else -1
    if begin < 0:
        return []
    try:
        found = json.JSONDecoder(strict=False).raw_decode(html, begin)[0]
    except ValueError:
        return []
    board = found.get("jobBoard")
    listed = board.get("jobPostings") if isinstance(board, dict) else None
    some = [x for x in listed if isinstance(x, dict) and x.get("id")] if isinstance(listed, list) else []
    return [{"id": str(x["id"]), "title": x["title"] if isinstance(x.get("title"), str) else ""} for x in some]


class PageView:
    """A page, walked once when a part first needs it."""

    def __init__(self, html: str | None, provider: str | None, patterns: sentences.Patterns | None):
        self.html, self.patterns = html or "", patterns
        self.result_words = RESULT_CARDS.get(provider, ("card", "result"))

    @cached_property
    def walked(self) -> _Walker:
        return _walk(self.html, cards=(*VENDOR_CARDS, *self.result_words))

    @cached_property
    def text(self) -> str:
        return squeeze(self.walked.text)

    @property
    def ended_text(self) -> str:
        return _ended_text(self.html)

    @cached_property
    def job(self) -> str:
        return "\n".join(p for p in (self.text, *_job_descriptions(self.html)) if p)

    @property
    def facts(self) -> list[dict]:
        return self.patterns.facts(self.text)

    @property
    def job_facts(self) -> list[dict]:
        return self.patterns.facts(self.job)

    @property
    def links(self) -> list[dict]:
        return [{"href": a, "text": squeeze(t)} for a, t in self.walked.links]

    @property
    def postings(self) -> list[dict]:
        return _embedded_list(self.html)

    @property
    def headline(self) -> str:
        return "\n".join(x for k in ("title", "meta", "h1", "h2") for x in self.walked.named.get(k, []))

    def _cards(self, words: tuple[str, ...], tags: tuple[str, ...]) -> list[dict]:
        return [c for c in self.walked.cards if c["tag"] in tags and any(w in c["class"] for w in words)]

    @property
    def cards(self) -> str:
        return squeeze([x for c in self._cards(self.result_words, ("div", "a")) for x in c["texts"]])

    @property
    def vendors(self) -> list[dict]:
        low = self.html.lower()
        plain = re.sub(r"<link[^>]+>|<script[^>]+src=[^>]+>", "", low)
        if not any(w in low for w in SUBPROCESSOR_TERMS) or not any(w in plain for w in SUBPROCESSOR_NAMES):
            return []
        return [r for t in self.walked.tables for r in _table_rows(t)] or _card_rows(self._cards(VENDOR_CARDS, ("div",))) or _term_rows(self.walked.terms)


PARTS = {"text": "string", "ended_text": "string", "links": LINKS, "postings": POSTINGS, "headline": "string", "job": "string", "cards": "string", "vendors": VENDOR_ROWS, "facts": sentences.FACTS, "job_facts": sentences.FACTS}


def page_view(html: Column, parts: tuple[str, ...], provider: Column | None = None, tables: sentences.Tables | None = None, hiring: list[str] = rules.HIRING_PHRASES) -> Column:
    """A struct of parts of a page: text, ended_text (only references that end in a semicolon are read), links, postings (an embedded job list), headline, job (text with
    embedded descriptions), cards (text in result cards of a provider's page), vendors (rows of a subprocessor page), and facts and job_facts of the texts' sentences."""

    @F.pandas_udf(", ".join(f"{p} {PARTS[p]}" for p in parts))
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        patterns = sentences.Patterns(tables, hiring) if tables else None
        for pages, providers in batches:
            rows = []
            for h, p in zip(pages, providers, strict=True):
                view = PageView(h, p, patterns)
                rows.append([getattr(view, part) for part in parts])
            yield pd.DataFrame({part: pd.Series([r[i] for r in rows], dtype=object) for i, part in enumerate(parts)})

    return read(html, F.lit(None).cast("string") if provider is None else provider)


def may_name(html: Column, words: Iterable[str]) -> Column:
    """Whether a page's source can hold one of the words in its text: it holds a word's first letters and digits, or writes letters as references."""
    first = {m[0] for w in words if (m := re.search("[a-z0-9]+", w))}
    return F.lower(html).rlike("|".join(sorted(first)) + "|&#|&fjlig")


def visible_text(html: Column, ended: bool = False) -> Column:
    """Text outside dropped tags. References are read as HTML has them, or, with `ended`, only those that end in a semicolon."""
    part = "ended_text" if ended else "text"
    return page_view(html, (part,))[part]


def extract_links(html: Column) -> Column:
    return page_view(html, ("links",))["links"]


def headline_text(html: Column) -> Column:
    """Title, description and og: contents, h1 and h2, one a line."""
    return page_view(html, ("headline",))["headline"]


def job_text(html: Column) -> Column:
    """Visible text and the description that some job boards embed as JSON."""
    return page_view(html, ("job",))["job"]


def card_text(html: Column, provider: Column) -> Column:
    """Text inside the result cards of a provider's page; what stands around them doesn't count."""
    return page_view(html, ("cards",), provider)["cards"]


def subprocessor_rows(html: Column) -> Column:
    """Vendor rows of a subprocessor page: tables with a name column, else cards, else definition lists; pages without a term and a provider's name give none."""
    return page_view(html, ("vendors",))["vendors"]


def article_text(html: Column) -> Column:
    """Text of <article> or the main role where there is one, else of the page; other tags are dropped, so it is a walk of its own."""

    def one(h: str | None) -> str:
        w = _walk(h, drops=ARTICLE_DROPS, inside=("article",))
        return squeeze(w.main or w.text)

    return _mapped("string", one)(html)
