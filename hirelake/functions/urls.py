"""Address functions as Column expressions; rules are tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Board:
    """How a job board's posting pages are recognised, cleaned and paged."""

    name: str
    host: str
    path: str  # pattern of the lower-case path of a posting
    key: tuple[str, str] | None = None  # (pattern of the posting's number, address it stands in)
    page: tuple[str, int] | None = None  # (parameter, step per page; 0: the page number itself)


# The job boards known by default.
BOARDS = (
    Board("linkedin", "linkedin.com", r"/jobs/view/", (r"^[^?#]*/view/+([^/?#]+)", "https://www.linkedin.com/jobs/view/"), ("start", 25)),
    Board("indeed", "indeed.com", r"/viewjob|/rc/clk", (r"^[^?#]*\?(?:[^#]*&)?jk=([^&#]+)", "https://de.indeed.com/viewjob?jk="), ("start", 10)),
    Board("stepstone", "stepstone.de", r"/stellenangebote--", None, ("page", 0)),
    Board("xing", "xing.com", r"^/jobs/(?!search)", None, ("page", 0)),
    Board("arbeitsagentur", "arbeitsagentur.de", r"/jobsuche/jobdetail/"),
    Board(
        "stellenwerk",
        "stellenwerk.de",
        r"^/+(darmstadt|frankfurt|heidelberg|hamburg|mainz|wiesbaden)/+([^/]+/+)*[^/]*\d[^/]*/*$",
        None,
        ("pagination%5Bstart%5D", 10),
    ),
)

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), r"^[^@]*@|:\d+$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def valid(url: Column) -> Column:
    return url.rlike(_PARTS)


def domain(url: Column) -> Column:
    """Host without www; null where there is none."""
    return F.when(valid(url), F.regexp_replace(host(url), r"^www\.", ""))


def source_of(url: Column, boards: tuple[Board, ...] = BOARDS) -> Column:
    """The board a posting's address belongs to, or null."""
    h, p = host(url), F.lower(path(url))
    return F.coalesce(*(F.when(h.contains(b.host) & p.rlike(b.path), F.lit(b.name)) for b in boards))


def without_tracking(url: Column) -> Column:
    """Address without parameters, fragment and one closing slash; null where invalid."""
    return F.when(valid(url), F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/$", ""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def posting_url(url: Column, source: Column, boards: tuple[Board, ...] = BOARDS) -> Column:
    """One address per posting: rebuilt from its number where the board has one; null without it."""
    out = None
    for b in boards:
        if b.key:
            number = F.regexp_extract(url, b.key[0], 1)
            value = F.when(number != "", F.concat(F.lit(b.key[1]), number))
        else:
            value = without_tracking(url)
        out = F.when(source == b.name, value) if out is None else out.when(source == b.name, value)
    return out


def page_url(url: Column, source: Column, page: Column, boards: tuple[Board, ...] = BOARDS) -> Column:
    """Address of a page of results; the first page, and boards without paging, have the address itself."""
    joint = F.when(url.contains("?"), "&").otherwise("?")
    out = F.when(page <= 1, url)
    for b in boards:
        if b.page:
            name, step = b.page
            value = (page - 1) * step if step else page
            out = out.when(source == b.name, F.concat(url, joint, F.lit(f"{name}="), value.cast("string")))
    return out.otherwise(url)


def plus_encoded(value: Column) -> Column:
    """Form encoding, with ~ left as it is."""
    return F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~"))


def path_encoded(value: Column) -> Column:
    return F.replace(F.replace(plus_encoded(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def apply_allowed(url: Column, source: Column, boards: tuple[Board, ...] = BOARDS) -> Column:
    """Leads away from the board that shows it, and not through a safety page."""
    own = F.coalesce(*(F.when(source == b.name, F.coalesce(domain(url), F.lit("")).contains(b.host)) for b in boards), F.lit(False))
    return F.coalesce(url != "", F.lit(False)) & ~url.contains("/safety/go") & ~own


# Parameters that carry a search's words.
SEARCH_PARAMETERS = ("keywords", "q", "what", "was")


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def search_words(urls: Column) -> Column:
    """The decoded values of the search parameters of addresses, decoded twice, in order."""

    def values_of(name: str, query: Column) -> Column:
        own = F.filter(query, lambda x: x.startswith(f"{name}="))
        return F.transform(own, lambda x: F.substr(x, F.lit(len(name) + 2)))

    def of(url: Column) -> Column:
        query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
        return F.concat(*(values_of(name, query) for name in SEARCH_PARAMETERS))

    values = F.flatten(F.transform(F.array_compact(urls), of))
    return F.filter(F.transform(values, lambda x: F.trim(_decoded(_decoded(x)))), lambda x: x != "")
