"""From parsed pages to normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import text as t
from hirelake.functions.urls import search_words

# What a header line of a posting says besides the place.
_HEADER = r" ago|reposted|clicked apply"


def header_fields(description: Column) -> tuple[Column, Column, Column]:
    """(company, title, location) from the lines up to the first header line, if two lines precede it."""
    parts = t.clean_lines(description)
    marks = F.transform(parts, lambda x: F.lower(x).rlike(_HEADER) & x.contains("·"))
    at = F.array_position(marks, True).cast("int")
    use = lambda back: F.when(at >= 3, F.get(parts, at - 1 - back))
    return use(2), use(1), use(0)


def keywords(queries: Column, urls: Column) -> Column:
    """Search queries, then the search parameters of addresses; each once, in order."""
    own = F.filter(F.transform(F.coalesce(queries, F.array().cast("array<string>")), t.collapse), lambda x: x != "")
    return F.array_distinct(F.concat(own, search_words(F.coalesce(urls, F.array().cast("array<string>")))))


def normalised(parsed: DataFrame, header_source: str | None = None) -> DataFrame:
    """Records with fallbacks for empty fields; rows of header_source are repaired from their header lines."""
    c = F.col
    company, title, location, body = c("company"), c("title"), c("location_raw"), c("description_raw")
    if header_source is not None:
        own = c("source") == header_source
        found = header_fields(body)
        company = F.when(own, t.first_filled(company, found[0])).otherwise(company)
        title = F.when(own, t.first_filled(title, found[1])).otherwise(title)
        location = F.when(own, t.first_filled(location, found[2])).otherwise(location)
        body = F.when(own, t.trim_description(body)).otherwise(body)
    has = lambda name: name in parsed.columns
    location = t.first_filled(location, c("location")) if has("location") else location
    queries = c("search_queries")
    if has("searchQuery"):
        queries = F.concat(F.coalesce(queries, F.array().cast("array<string>")), F.array_compact(F.array("searchQuery")))
    sources = F.when(F.size("sources") > 0, c("sources")).when(c("source") != "", F.array("source")).otherwise(F.array().cast("array<string>"))
    # the description is trimmed and read for types once per record
    parsed = parsed.withColumn("__body", body).withColumn("__types", t.inferred_types(c("__body")))
    return parsed.select(
        *(x for x in ("detail_id",) if x in parsed.columns),
        t.first_filled(c("url"), c("source_job_url")).alias("url"),
        c("source_job_url"),
        sources.alias("sources"),
        keywords(queries, c("search_urls")).alias("search_keywords"),
        title.alias("title"),
        company.alias("company"),
        location.alias("location_raw"),
        t.trim_description(c("__body")).alias("description_raw"),
        t.first_filled(c("workplace_type_raw"), c("__types.workplace")).alias("workplace_type_raw"),
        t.first_filled(c("employment_type_raw"), c("__types.employment")).alias("employment_type_raw"),
        c("apply_url"),
    )


def parsed_successfully() -> Column:
    return F.greatest(*(F.coalesce(F.col(c) != "", F.lit(False)) for c in ("title", "company", "location_raw", "description_raw")))
