"""Stored pages: fields, blocks, links and cards by selector tables, one parse per page in Arrow batches.

Selectors are lists of compounds (tag, .class, #id, [attribute], [attribute='v'], [attribute*='v']) divided
by blanks, each inside the one before. What a page says is read in Python; rules about addresses, noise and
fallbacks are column expressions on what was read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import blank_to_null, first_filled, trim_noise
from hirelake.functions.urls import BOARDS, Board, apply_allowed, posting_url, source_of

# Elements that end a line, and those without content of their own.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p section table td th tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))

#: field -> selectors (tag, .class, #id, [attribute] and their combinations), in order.
SELECTORS = {
    "title": ("h1", "[data-title]", "title"),
    "company": (".company", "[data-company]"),
    "location": (".location", "[data-location]"),
    "description": ("#description", ".description", "main", "article"),
}
#: A block shorter than this is no description.
LEAST_DESCRIPTION = 80
# What links to an application say.
APPLY_WORDS = ("apply", "bewerben", "bewerbung")
MOST_LINKS = 250


# Where boards show the fields of a posting, in order; other boards under "".
DETAIL_SELECTORS = {
    "title": {
        "linkedin": (".job-details-jobs-unified-top-card__job-title h1", ".top-card-layout__title", "h1"),
        "indeed": ("h1[data-testid='jobsearch-JobInfoHeader-title']", "[data-testid='jobsearch-JobInfoHeader-title'] h1", "h1"),
        "stepstone": ("[data-at='header-job-title']", "[data-testid='job-title']", "h1"),
        "xing": ("h1", "[data-testid*='job-title']"),
        "arbeitsagentur": ("h1", "[data-testid*='beruf']"),
        "stellenwerk": ("h1", ".node-title"),
        "": ("h1",),
    },
    "company": {
        "linkedin": (
            ".job-details-jobs-unified-top-card__company-name a", ".job-details-jobs-unified-top-card__company-name", ".topcard__org-name-link",
        ),
        "indeed": (
            "[data-testid='inlineHeader-companyName']", "[data-company-name='true']", ".jobsearch-CompanyInfoContainer a",
            ".jobsearch-CompanyInfoContainer",
        ),
        "stepstone": ("[data-at='header-company-name']", "[data-testid='company-name']", "a[href*='/cmp/']"),
        "xing": ("[data-testid*='company']", "a[href*='/companies/']"),
        "arbeitsagentur": ("[data-testid*='arbeitgeber']", "[data-testid*='company']"),
        "stellenwerk": (".field--name-field-company", "[class*='company']"),
        "": ("[class*='company']",),
    },
    "location": {
        "linkedin": (".job-details-jobs-unified-top-card__primary-description-container", ".topcard__flavor--bullet"),
        "indeed": ("[data-testid='job-location']", "[data-testid='inlineHeader-companyLocation']", ".jobsearch-JobInfoHeader-subtitle div"),
        "stepstone": ("[data-at='header-job-location']", "[data-testid='job-location']", "[class*='location']"),
        "xing": ("[data-testid*='location']", "[class*='location']"),
        "arbeitsagentur": ("[data-testid*='arbeitsort']", "[data-testid*='location']"),
        "stellenwerk": (".field--name-field-location", "[class*='location']"),
        "": ("[class*='location']",),
    },
    "description": {
        "linkedin": (
            ".jobs-description__content", ".jobs-box__html-content", ".jobs-description-content__text", ".show-more-less-html__markup",
        ),
        "indeed": ("#jobDescriptionText", "[data-testid='jobsearch-JobComponent-description']", ".jobsearch-jobDescriptionText"),
        "stepstone": ("[data-at='job-ad-content']", "[data-testid='job-description']", "article", "main section"),
        "xing": ("[data-testid*='description']", "article", "main"),
        "arbeitsagentur": ("[data-testid*='stellenbeschreibung']", "[data-testid*='description']", "main"),
        "stellenwerk": (".field--name-body", "article", "main"),
        "": ("article", "main"),
    },
}
APPLY_SELECTORS = (
    "a[href][aria-label*='Apply']", "a[href][aria-label*='Bewerben']", "a[href][data-control-name*='jobdetails_topcard']", "a[href][id*='apply']",
    "a[href][class*='apply']", "a[href*='/apply']", "a[href*='/bewerben']", "a[href*='/applystart']", "a[href*='indeedapply']",
)
# Where the card around a link shows a posting's fields.
CARD_TAGS = frozenset(("article", "li", "div"))
CARD_SELECTORS = {
    "title": ("h1", "h2", "h3", "[data-testid*='title']", "[class*='title']", "[class*='jobTitle']"),
    "company": ("[data-testid*='company']", "[class*='company']", "[class*='Company']"),
    "location": ("[data-testid*='location']", "[class*='location']", "[class*='Location']"),
}


class _Element:
    __slots__ = ("tag", "attributes", "text", "parent", "at", "end")

    def __init__(self, tag, attributes, parent, at):
        self.tag, self.attributes, self.text, self.parent, self.at, self.end = tag, attributes, [], parent, at, None


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.stack: list[_Element] = []
        self.hidden = 0

    def handle_starttag(self, tag, attributes):
        if tag in HIDDEN:
            self.hidden += 1
        element = _Element(tag, {k: v or "" for k, v in attributes}, self.stack[-1] if self.stack else None, len(self.elements))
        self.elements.append(element)
        if tag in BLOCKS:
            for outer in self.stack:
                outer.text.append("\n")
        if tag not in VOID:
            self.stack.append(element)

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if any(e.tag == tag for e in self.stack):
            while self.stack:
                closed = self.stack.pop()
                if closed.tag == tag:
                    break
            if tag in BLOCKS:
                for outer in self.stack:
                    outer.text.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            for element in self.stack:
                element.text.append(data)


def _text(element: _Element) -> str:
    lines = (" ".join(line.split()) for line in "".join(element.text).split("\n"))
    return "\n".join(line for line in lines if line)


_SIMPLE = re.compile(r"""(?P<tag>^[\w-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>\*?=)'(?P<value>[^']*)')?\]""")


@lru_cache(maxsize=1000)
def _compiled(selector: str) -> tuple:
    """Compounds, innermost first; each a tuple of (kind, name, value)."""
    out = []
    for compound in re.split(r"\s+(?![^\[]*\])", selector.strip()):  # blanks within brackets divide nothing
        tests = []
        for m in _SIMPLE.finditer(compound):
            if m["tag"]:
                tests.append(("tag", m["tag"], ""))
            elif m["cls"]:
                tests.append(("class", m["cls"], ""))
            elif m["id"]:
                tests.append(("=", "id", m["id"]))
            else:
                tests.append((m["op"] or "has", m["name"], m["value"] or ""))
        out.append(tuple(tests))
    return tuple(reversed(out))


def _passes(element: _Element, tests: tuple) -> bool:
    own = element.attributes
    for kind, name, value in tests:
        if kind == "tag":
            fits = element.tag == name
        elif kind == "class":
            fits = name in own.get("class", "").split()
        elif kind == "has":
            fits = name in own
        elif kind == "=":
            fits = own.get(name) == value
        else:
            fits = value in own.get(name, "")
        if not fits:
            return False
    return True


def _fits(element: _Element, selector: str) -> bool:
    inner, *outer = _compiled(selector)
    if not _passes(element, inner):
        return False
    above = element.parent
    for tests in outer:
        while above is not None and not _passes(above, tests):
            above = above.parent
        if above is None:
            return False
        above = above.parent
    return True


def _found(elements, selectors) -> Iterator[_Element]:
    """Elements by selector, then in the order of the page."""
    for selector in selectors:
        for element in elements:
            if _fits(element, selector):
                yield element


def all_texts(elements, selectors) -> list[str]:
    """Filled texts of all elements found, each once."""
    return list(dict.fromkeys(t for t in map(_text, _found(elements, selectors)) if t))


def first_text(elements, selectors) -> str | None:
    """The text of the first element of the first selector whose first element has one."""
    for selector in selectors:
        first = next((e for e in elements if _fits(e, selector)), None)
        text = _text(first) if first is not None else ""
        if text:
            return text
    return None


def _read(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _inside(elements: list[_Element], outer: _Element) -> list[_Element]:
    """The elements within another; they follow it without a gap."""
    found = []
    for e in elements[outer.at + 1 :]:
        above = e.parent
        while above is not None and above.at > outer.at:
            above = above.parent
        if above is not outer:
            break
        found.append(e)
    return found


def _links(page: _Page) -> list[_Element]:
    return [e for e in page.elements if e.tag == "a" and e.attributes.get("href")]


def _absolute(url: str | None, href: str) -> str:
    try:
        return urljoin(url or "", href)
    except ValueError:
        return href


def read_detail(html: str | None, url: str | None, source: str | None) -> tuple:
    """(title, company, location, description, apply addresses in order of preference) of a posting's page."""
    page = _read(html)
    of = lambda field: DETAIL_SELECTORS[field].get(source or "", DETAIL_SELECTORS[field][""])
    long = [t for t in all_texts(page.elements, of("description")) if len(t) > LEAST_DESCRIPTION]
    body = next((e for e in page.elements if e.tag == "body"), None)
    text = max(long, key=len) if long else _text(body) if body is not None else None  # of equal ones the first
    first = [next((e for e in page.elements if _fits(e, s)), None) for s in APPLY_SELECTORS]
    said = [
        e for e in _links(page)[:MOST_LINKS] if any(w in f"{_text(e)} {e.attributes.get('aria-label', '')}".lower() for w in APPLY_WORDS)
    ]
    apply = [_absolute(url, e.attributes["href"]) for e in (*first, *said) if e is not None and e.attributes.get("href")]
    return *(first_text(page.elements, of(f)) for f in ("title", "company", "location")), text or None, apply


def read_cards(html: str | None, url: str | None) -> list[dict]:
    """Every link of a page with the fields of the card around it, in order."""
    page = _read(html)
    out = []
    for n, link in enumerate(_links(page)):
        card = link.parent
        while card is not None and card.tag not in CARD_TAGS:
            card = card.parent
        within = _inside(page.elements, card) if card is not None else []
        fields = {name: first_text(within, selectors) for name, selectors in CARD_SELECTORS.items()}
        fields["title"] = fields["title"] or _text(link) or None
        out.append({"position": n, "href": _absolute(url, link.attributes["href"]), **fields})
    return out


def detail_records(pages: DataFrame, key: str, html: str, record: dict[str, str] | None = None, boards: tuple[Board, ...] = BOARDS) -> DataFrame:
    """Parsed postings of stored pages.

    record names the columns of pages that hold what the search page said: url, source, title, company,
    location, search_url, search_query; a field of the page counts before it. Pages without a source
    belong to the board of their address.
    """
    said = {name: name for name in ("url", "source", "title", "company", "location", "search_url", "search_query")} | (record or {})
    have = lambda name: F.col(said[name]) if said[name] in pages.columns else F.lit(None).cast("string")
    kind = pages.schema[key].dataType.simpleString()
    source = first_filled(have("source"), source_of(have("url"), boards), F.lit("unknown"))
    rows = pages.select(
        F.col(key).alias("id"), have("url").alias("url"), source.alias("source"), F.col(html).alias("html"),
        *(have(n).alias(f"said_{n}") for n in ("title", "company", "location", "search_url", "search_query")),
    )
    passed = ["said_title", "said_company", "said_location", "said_search_url", "said_search_query"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (batch.column(n).to_pylist() for n in ("html", "url", "source"))
            found = list(zip(*(read_detail(*row) for row in zip(*texts)))) if batch.num_rows else [[]] * 5
            columns = [pa.array(c, pa.string()) for c in found[:4]] + [pa.array(found[4], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), batch.column("source"), *columns, *(batch.column(c) for c in passed)],
                names=["id", "url", "source", "title", "company", "location", "description", "apply", *passed],
            )

    strings = ", ".join(f"{c} string" for c in ("url", "source", "title", "company", "location", "description"))
    read = rows.mapInArrow(run, f"id {kind}, {strings}, apply array<string>, {', '.join(f'{c} string' for c in passed)}")
    field = lambda name: first_filled(F.col(name), F.col(f"said_{name}"))
    listed = lambda c: F.when(blank_to_null(F.col(c)).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return read.select(
        F.col("id").alias(key), "url", F.col("url").alias("source_job_url"), "source", listed("source").alias("sources"),
        listed("said_search_url").alias("search_urls"), listed("said_search_query").alias("search_queries"),
        field("title").alias("title"), field("company").alias("company"), field("location").alias("location_raw"),
        trim_noise(F.col("description")).alias("description_raw"),
        F.lit(None).cast("string").alias("workplace_type_raw"), F.lit(None).cast("string").alias("employment_type_raw"),
        F.get(F.filter("apply", lambda x: apply_allowed(x, F.col("source"), boards)), 0).alias("apply_url"),
    ).withColumn("parse_success", _any_filled("title", "company", "location_raw", "description_raw"))


def _any_filled(*columns: str) -> Column:
    return F.coalesce(*(blank_to_null(F.col(c)) for c in columns)).isNotNull()


def collected_records(pages: DataFrame, key: str, url: str, html: str, source: str | None = None, boards: tuple[Board, ...] = BOARDS) -> DataFrame:
    """(key, position, source, url, title, company, location): the postings that stored search pages link to.

    Each posting once per page, by its first link; with source, a column of pages, only that board's.
    """
    kind = pages.schema[key].dataType.simpleString()
    card = pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("href", "title", "company", "location"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_cards(h, u) for h, u in zip(batch.column("html").to_pylist(), batch.column("page").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("wanted"), pa.array(found, pa.list_(card))], names=["id", "wanted", "cards"])

    wanted = F.col(source) if source else F.lit(None).cast("string")
    rows = pages.select(F.col(key).alias("id"), wanted.alias("wanted"), F.col(url).alias("page"), F.col(html).alias("html"))
    cards = "array<struct<position int, href string, title string, company string, location string>>"
    links = rows.mapInArrow(run, f"id {kind}, wanted string, cards {cards}").select("id", "wanted", F.inline("cards"))
    links = links.withColumn("source", source_of(F.col("href"), boards)).where(F.col("source").isNotNull())
    links = links.where(F.coalesce(blank_to_null(F.col("wanted")) == F.col("source"), F.lit(True)))
    links = links.withColumn("url", posting_url(F.col("href"), F.col("source"), boards)).where(F.col("url").isNotNull())
    first = links.groupBy("id", "url").agg(F.min(F.struct("position", "source", "title", "company", "location")).alias("r"))
    return first.select(F.col("id").alias(key), "r.position", "r.source", "url", "r.title", "r.company", "r.location")


def parse(html: str, url: str, selectors: dict[str, tuple[str, ...]]):
    """(fields, links, apply address) of a page by selectors of one's own."""
    page = _read(html)
    fields = {}
    for name, options in selectors.items():
        if name == "description":
            long = [t for t in all_texts(page.elements, options) if len(t) > LEAST_DESCRIPTION]
            fields[name] = max(long, key=len) if long else None  # of equal ones the first
        else:
            fields[name] = next((t for t in map(_text, _found(page.elements, options)) if t), None)
    links = [_absolute(url, e.attributes["href"]) for e in _links(page)]
    apply = next(
        (
            _absolute(url, e.attributes["href"])
            for e in _links(page)[:MOST_LINKS]
            if any(w in f"{_text(e)} {e.attributes.get('aria-label', '')}".lower() for w in APPLY_WORDS)
        ),
        None,
    )
    return fields, list(dict.fromkeys(links)), apply


def parse_pages(pages: DataFrame, key: str, url: str, html: str, selectors: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, <field>..., links, apply_url) of stored pages."""
    chosen = selectors or SELECTORS
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(h or "", u or "", chosen) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([f[0][name] for f in found], pa.string()) for name in chosen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.string())],
                names=["id", *chosen, "links", "apply_url"],
            )

    fields = ", ".join(f"{name} string" for name in chosen)
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, {fields}, links array<string>, apply_url string").withColumnRenamed("id", key)
