"""Registry of the core queries over the tables of a folder, with DuckDB SQL for each."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import text as t
from hirelake.functions import urls as u
from hirelake.operators import excerpt, export, normalise, ordering, queue, scoring
from hirelake.plans import sql
from hirelake.runtime import new_folder, ship, spread, table
from hirelake.sinks.files import column_widths, write_jsonl, write_run
from hirelake.sources import html
from hirelake.sources.files import read_jsonl, read_queue
from hirelake.streaming.pool import Pool, page_statistics
from hirelake.streaming.runs import Runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _texts(spark, d, name: str, *columns: str) -> DataFrame:
    """Some columns of a table whose texts cost more to work on than to move."""
    return spread(table(spark, d, name).select(*columns))


@query
def sightings_by_source(spark, d):
    """Sightings and distinct postings by source."""
    rows = table(spark, d, "collected").groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("sightings"), F.countDistinct("url").alias("postings"))


flagship = sightings_by_source


@query
def dedup_first_wins(spark, d):
    rows = table(spark, d, "collected").select("url", "seq", "source", "title").where(F.col("url").isNotNull())
    return ordering.distinct_by_key(rows, F.col("url"), "seq")


@query
def merge_pool(spark, d):
    """First result pages are the old pool, all others the new rows."""
    rows = table(spark, d, "collected").select("url", "seq", "title", "result_page_number")
    first = F.coalesce(F.col("result_page_number") == 1, F.lit(False))
    columns = ["url", "seq", "title"]
    return ordering.merge_pool(rows.where(first).select(*columns), rows.where(~first).select(*columns), "url", "seq")


@query
def merge_by_key_expression(spark, d):
    rows = table(spark, d, "parsed_detail").select("detail_id", "url", "source_job_url", "title")
    return ordering.distinct_by_key(rows, t.first_filled(F.col("source_job_url"), F.col("url")), "detail_id")


@query
def page_stats(spark, d):
    return page_statistics(table(spark, d, "collected").select("run_id", "search_url", "url", "title"))


@query
def pool_totals(spark, d):
    """Per run: rows, distinct postings, and postings no earlier run has seen."""
    rows = table(spark, d, "collected").where(F.col("url").isNotNull())
    first = rows.groupBy("url").agg(F.min("run_id").alias("run_id"))
    per_run = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))
    added = first.groupBy("run_id").agg(F.count(F.lit(1)).alias("added"))
    return per_run.join(added, "run_id", "left").select("run_id", "n", "urls", F.coalesce("added", F.lit(0)).alias("added"))


@query
def pages_without_sightings(spark, d):
    """Queue pages that no sighting came from."""
    seen = table(spark, d, "collected").select(F.col("search_url").alias("url")).where(F.col("url").isNotNull()).distinct()
    return table(spark, d, "queue_generated").select("seq", "url").join(seen, "url", "left_anti").select("seq", "url")


@query
def queue_distinct_queries(spark, d):
    return queue.ordered_distinct(table(spark, d, "queue_generated"), "search_query", "seq")


@query
def queue_interleaved(spark, d):
    rows = table(spark, d, "queue_generated").select("seq", "search_query")
    return ordering.interleave(rows, "search_query", "seq").select("seq", F.col("turn").cast("bigint").alias("turn"), "lane")


@query
def queue_cap_per_source(spark, d):
    rows = table(spark, d, "queue_generated").select("seq", "source")
    return ordering.cap_per_group(rows, "source", [F.col("seq")], 40).select("seq", "source", F.col("position").cast("bigint").alias("position"))


def _ranked_queue(spark, d):
    rows = table(spark, d, "queue_generated").select("seq", "source", "search_query", "url")
    ranks = rows.groupBy("source").agg(F.min("seq").alias("source_rank"))
    return rows.join(F.broadcast(ranks), "source")  # one row per source of the configuration


@query
def queue_fair(spark, d):
    found = queue.fair_queue(_ranked_queue(spark, d), "search_query", "seq", 40, 240)
    return found.select(F.col("place").cast("bigint").alias("place"), "seq", "source")


@query
def queue_counts(spark, d):
    return table(spark, d, "queue_generated").groupBy("source", "query_group").agg(F.count(F.lit(1)).alias("n"))


@query
def queue_grid(spark, d):
    """All queries at all locations on two pages of three sources, one of which knows two places only."""
    rows = table(spark, d, "queue_generated")
    texts = queue.ordered_distinct(rows, "search_query", "seq").select(F.col("search_query").alias("query"), F.col("seq").alias("query_no"))
    places = queue.ordered_distinct(rows, "search_location", "seq").select(F.col("search_location").alias("location"), F.col("seq").alias("location_no"))
    sources = spark.createDataFrame(
        [
            ("indeed", 0, "https://a.example/jobs?q={query_plus}&l={location_plus}", 2, None),
            ("stepstone", 1, "https://b.example/jobs/{query_slug}/in-{location_slug}", 2, []),
            ("arbeitsagentur", 2, "https://c.example/suche?was={query_quote}", 1, ["Zwistbach", "Löppbach"]),
        ],
        "source string, source_rank int, template string, pages int, locations array<string>",
    )
    return queue.grid(texts, places, sources).select("source", "query", "location", F.col("page_number").cast("bigint").alias("page_number"), "url")


#: A configuration of two boards for the texts and places of the queue table.
PLANNED = {
    "defaults": {"recent_days": 7},
    "sources": {
        "xing": {"enabled": True, "url_template": "https://x.example/jobs?k={query_plus}&l={location_plus}&age={recent_days}"},
        "off": {"url_template": "https://off.example/{query}"},
        "indeed": {"enabled": True, "display_name": "Indeed", "url_template": "https://i.example/{location_slug}?q={query_plus}&r={radius_km}",
                   "supported_locations": ["Zwistbach", "Löppbach"], "location_slug_overrides": {"Zwistbach": "zw"}, "max_pages_per_search": 2},
    },
    "discovery": {"source_order": ["indeed", "gone"]},
    "run_safety": {"max_urls_per_source": 30, "max_total_urls": 50},
}


@query
def queue_planned(spark, d):
    """The queue of a configuration whose queries and places are those of the queue table."""
    rows = table(spark, d, "queue_generated")
    values = lambda c: [r[c] for r in queue.ordered_distinct(rows, c, "seq").orderBy("seq").collect()]  # noqa: E731  configuration
    config = PLANNED | {"query_generation": {"explicit_queries": values("search_query"), "active_locations": values("search_location")}}
    found = queue.planned_queue(spark, config)
    return found.select(F.col("place").cast("bigint").alias("place"), "source", "source_name", "query", "location", F.col("page_number").cast("bigint").alias("page_number"), "url")


@query
def slugs(spark, d):
    rows = table(spark, d, "queue_generated").select("search_query", "search_location").distinct()
    return rows.select("search_query", "search_location", t.slugify(F.col("search_query")).alias("query_slug"), t.slugify(F.col("search_location")).alias("location_slug"))


@query
def posting_domains(spark, d):
    rows = table(spark, d, "collected")
    return rows.groupBy(u.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query
def urls_without_tracking(spark, d):
    rows = table(spark, d, "parsed_detail")
    return rows.select("detail_id", u.without_tracking(F.col("source_job_url")).alias("clean"), u.without_fragment(F.col("source_job_url")).alias("page"))


#: Addresses of the known boards for every sighting, by its number.
BOARD_URLS = """CASE CAST(seq % 8 AS INT)
    WHEN 0 THEN concat('https://de.indeed.com/viewjob?from=x&jk=k', CAST(seq % 50 AS STRING))
    WHEN 1 THEN concat('https://www.linkedin.com/jobs/view/', CAST(seq % 50 AS STRING), '/?trk=a#b')
    WHEN 2 THEN concat('https://www.stepstone.de/stellenangebote--data-', CAST(seq % 50 AS STRING), '.html?rltr=1')
    WHEN 3 THEN concat('https://www.xing.com/jobs/data-', CAST(seq % 50 AS STRING), '/')
    WHEN 4 THEN concat('https://www.arbeitsagentur.de/jobsuche/jobdetail/', CAST(seq % 50 AS STRING), '#top')
    WHEN 5 THEN concat('https://www.stellenwerk.de/mainz/job-', CAST(seq % 50 AS STRING))
    WHEN 6 THEN concat('https://www.xing.com/jobs/search?keywords=', CAST(seq % 50 AS STRING))
    ELSE url END"""


@query
def board_postings(spark, d):
    rows = table(spark, d, "collected").select("seq", F.expr(BOARD_URLS).alias("url_job"))
    found = rows.withColumn("board", u.source_of(F.col("url_job")))
    return found.select("seq", "board", u.posting_url(F.col("url_job"), F.col("board")).alias("posting"))


@query
def board_pages(spark, d):
    rows = table(spark, d, "queue_generated").select("seq", "page_number", F.expr("element_at(array('indeed', 'linkedin', 'stepstone', 'xing', 'arbeitsagentur', 'stellenwerk'), CAST(seq % 6 AS INT) + 1)").alias("board"), u.without_tracking(F.col("url")).alias("base"))
    return rows.select("seq", u.page_url(F.col("base"), F.col("board"), F.col("page_number")).alias("page_url"))


@query
def apply_urls_allowed(spark, d):
    boards = tuple(u.Board(n, f"{n}.example", "/") for n in ("talentora", "jobquarry", "stellenkiosk", "zingwork", "arbeitshafen", "campuswerk"))
    rows = table(spark, d, "parsed_detail")
    return rows.groupBy("source", u.apply_allowed(F.col("apply_url"), F.col("source"), boards).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query
def search_keywords(spark, d):
    rows = table(spark, d, "parsed_detail")
    return rows.select("detail_id", F.array_join(normalise.keywords(F.col("search_queries"), F.col("search_urls")), "|").alias("keywords"))


@query
def normalised_texts(spark, d):
    return _texts(spark, d, "parsed_detail", "detail_id", "title", "description_raw").select("detail_id", F.md5(t.normalize(F.col("description_raw"))).alias("digest"), t.normalize(F.col("title")).alias("title"))


@query
def cleaned_lines(spark, d):
    rows = _texts(spark, d, "parsed_detail", "detail_id", "description_raw")
    found = t.clean_lines(F.col("description_raw"))
    return rows.select("detail_id", F.size(found).cast("bigint").alias("n"), F.md5(F.array_join(found, "\n")).alias("digest"))


@query
def trimmed_descriptions(spark, d):
    rows = _texts(spark, d, "parsed_detail", "detail_id", "description_raw")
    body = F.concat_ws("\n", F.lit("Deine Aufgaben"), "description_raw", F.lit("Weitere Jobs you may like"))
    return rows.select(
        "detail_id",
        F.md5(t.trim_description(F.col("description_raw"))).alias("plain"),
        F.md5(t.trim_description(body)).alias("marked"),
        F.md5(t.trim_noise(body)).alias("noise"),
    )


@query
def inferred_types(spark, d):
    rows = _texts(spark, d, "parsed_detail", "detail_id", "description_raw")
    return rows.select("detail_id", t.inferred_types(F.col("description_raw")).alias("types")).select("detail_id", "types.*")


@query
def normalised_records(spark, d):
    rows = normalise.normalised(spread(table(spark, d, "parsed_detail")))
    return rows.select("detail_id", "url", F.array_join("sources", ",").alias("sources"), "workplace_type_raw", "employment_type_raw", F.array_join("search_keywords", "|").alias("search_keywords"))


@query
def header_repair(spark, d):
    """Records of one board repaired from header lines that are put before every description."""
    head = F.concat_ws("\n", F.coalesce("company", F.lit("Firma")), F.coalesce("source", F.lit("x")), F.concat(F.lit("Ort · "), "detail_id", F.lit(" days ago")), "description_raw")
    found = normalise.header_fields(head)
    return _texts(spark, d, "parsed_detail", "detail_id", "company", "source", "description_raw").select("detail_id", found[0].alias("company"), found[1].alias("title"), found[2].alias("location"))


@query
def parse_counts(spark, d):
    ok = normalise.parsed_successfully()
    return table(spark, d, "parsed_detail").groupBy("source").agg(F.count(F.lit(1)).alias("parsed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


@query
def section_excerpts(spark, d):
    return _texts(spark, d, "parsed_detail", "detail_id", "description_raw").select("detail_id", F.md5(excerpt.excerpt(F.col("description_raw"))).alias("digest"))


@query
def compact_descriptions(spark, d):
    rows = _texts(spark, d, "documents", "doc_id", "text").select("doc_id", excerpt.compact(F.col("text")).alias("c"))
    return rows.select("doc_id", F.length("c").cast("bigint").alias("n"), F.md5("c").alias("digest"))


@query
def candidate_ids(spark, d):
    rows = table(spark, d, "parsed_detail").where(F.col("parse_success")).select("detail_id")
    return ordering.numbered(rows, [F.col("detail_id")], "candidate_id", "job_%04d")


@query
def numbered_lines(spark, d):
    """All order lines by price, each with its position."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return ordering.numbered(rows, order, "line_id", "line_%06d").drop("l_extendedprice")


@query
def role_kinds(spark, d):
    text = F.concat_ws(" ", "title", "employment_type_raw")
    return table(spark, d, "parsed_detail").groupBy(t.role_kind(text, F.col("employment_type_raw")).alias("role_kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def marker_votes(spark, d):
    phrases = "element_at(array('', 'Wir suchen dich. Deine Aufgaben', 'About the role: requirements', 'Studium und requirements', 'Kenntnisse'), CAST(doc_id % 5 AS INT) + 1)"
    rows = _texts(spark, d, "documents", "doc_id", "lang", "text").select("lang", F.concat_ws("\n", "text", F.expr(phrases)).alias("text"))
    return rows.groupBy("lang", t.marker_vote(F.col("text")).alias("vote")).agg(F.count(F.lit(1)).alias("n"))


@query
def first_matches(spark, d):
    """The first of ordered literals and of ordered patterns."""
    text = t.normalize(F.col("text"))
    rows = _texts(spark, d, "documents", "text").select(
        t.first_literal(text, ("python", "sql", "java", "daten", "data")).alias("literal"),
        t.first_pattern(text, (r"[0-9]+ (monaten|months)", r"haus [0-9]+", r"building [0-9]+")).alias("pattern"),
    )
    return rows.groupBy("literal", "pattern").agg(F.count(F.lit(1)).alias("n"))


#: Answers of a scoring service in all their shapes, by number.
ANSWERS = (
    '{"score": 8, "category": "target", "reason": "fits", "fit_tags": ["a", " ", "b", "c", "d", "e", "f"]}',
    '```json\n{"score": "7", "category": "Target "}\n```',
    'Sure: {"score": 7.9, "fit_tags": []} done',
    '{"score": "7.9"}',
    '{"score": true}',
    '{"score": null, "category": "other"}',
    '{"score": [1]}',
    '{"score": -3}',
    '{"score": 42, "category": "alternative"}',
    "no object",
    '[1, 2]',
)


def _answers(spark, d):
    shapes = F.array(*map(F.lit, ANSWERS))
    return table(spark, d, "parsed_detail").select("detail_id", F.get(shapes, (F.col("detail_id") % len(ANSWERS)).cast("int")).alias("answer"))


@query
def answers_parsed(spark, d):
    rows = _answers(spark, d).withColumn("v", scoring.answer_object(F.col("answer")))
    return rows.select(
        "detail_id",
        F.col("v").isNotNull().alias("is_object"),
        F.when(F.col("v").isNotNull(), scoring.answer_number(F.col("v"), "score", 0, 10)).alias("score"),
        F.array_join(scoring.answer_tags(F.col("v"), "fit_tags"), ",").alias("tags"),
    )


def _requests(spark, d):
    key = scoring.request_key(F.lit("model"), F.lit("profile"), "title", "company", "source_job_url")
    return table(spark, d, "parsed_detail").select("detail_id", "source", key.alias("key"))


@query
def request_keys(spark, d):
    return _requests(spark, d).select("detail_id", "key")


@query
def cache_hits_and_misses(spark, d):
    """The cache holds the answers to one board's requests."""
    requests = _requests(spark, d)
    cache = requests.where(F.col("source") == "talentora").select("key", F.lit("{}").alias("answer"))
    hits, misses = scoring.cached(requests, cache)
    both = hits.select("source", F.lit(True).alias("hit")).unionByName(misses.select("source", F.lit(False).alias("hit")))
    return both.groupBy("source", "hit").agg(F.count(F.lit(1)).alias("n"))


def chat_body(answer):
    """An answer as a chat service wraps it."""
    message = F.struct(F.struct(answer.alias("content")).alias("message"))
    usage = F.struct(F.lit(100).alias("prompt_tokens"), F.length(answer).alias("completion_tokens"))
    return F.to_json(F.struct(F.array(message).alias("choices"), usage.alias("usage")))


@query
def scored_postings(spark, d):
    """Postings with the answers of a replayed service in all shapes, every fifth from the cache, every seventh missing."""
    rows = _answers(spark, d).withColumn("key", F.col("detail_id").cast("string"))
    answers = rows.where("detail_id % 7 <> 0").select(
        "key", chat_body(F.col("answer")).alias("answer"), F.lit(None).cast("string").alias("error"), (F.col("detail_id") % 5 == 0).alias("cache_hit")
    )
    found = scoring.scored_rows(rows.select("detail_id", "key"), answers, "replay")
    return found.select("detail_id", "llm_score", "llm_category", F.size("llm_fit_tags").cast("bigint").alias("tags"), "llm_cache_hit",
                        F.col("llm_error").isNotNull().alias("failed"), F.col("llm_usage.completion_tokens").alias("completion_tokens"))


@query
def cache_round_trip(spark, d):
    """Requests answered by a service that shouts, twice: the second time all from the cache."""
    path = new_folder(spark, "cache")
    requests = table(spark, d, "employer_feed").select(F.col("feed_id").cast("string").alias("key"), F.coalesce("title", F.lit("-")).alias("prompt"))
    client = _shout
    scoring.answered(requests, path, client).count()
    again = scoring.answered(requests, path, client)
    return again.groupBy("cache_hit").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))


def _shout(prompt: str) -> str:
    return json.dumps({"choices": [{"message": {"content": json.dumps({"score": len(prompt) % 10})}}]})


#: Marks by which six boards show a company and a place, in the order of BOARD_NAMES.
BOARD_NAMES = ("linkedin", "indeed", "stepstone", "xing", "arbeitsagentur", "stellenwerk")
COMPANY_MARKS = ("class='topcard__org-name-link'", "data-company-name='true'", "data-testid='company-name'", "data-testid='the-company'", "data-testid='arbeitgeber-1'", "class='field--name-field-company'")
PLACE_MARKS = ("class='topcard__flavor--bullet'", "data-testid='job-location'", "class='job-location'", "data-testid='a-location'", "data-testid='arbeitsort-1'", "class='field--name-field-location'")


def _markup(value):
    """A text as it stands in a page."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(plain), F.lit(written))
    return F.coalesce(value, F.lit(""))


@query
def detail_pages(spark, d):
    """Postings written as pages of six boards and parsed again; what a page lacks comes from the search page's record."""
    n = (F.col("detail_id") % 6).cast("int")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), n)
    rows = table(spark, d, "parsed_detail").select(
        "detail_id", pick(BOARD_NAMES).alias("source"), "url", F.lit("Title of the search page").alias("title"), F.col("apply_url").alias("apply"),
        F.concat(
            F.lit("<html><head><title>x</title></head><body><nav>Menu</nav><h1> "), _markup(F.col("title")), F.lit("</h1><p "), pick(COMPANY_MARKS), F.lit(">"),
            _markup(F.col("company")), F.lit("</p><p "), pick(PLACE_MARKS), F.lit(">"), _markup(F.col("location_raw")), F.lit("</p><a class='apply-x' href='"),
            _markup(F.col("apply_url")), F.lit("'>Go</a><script>let x = 1;</script></body></html>"),
        ).alias("html"),
    )
    found = html.detail_records(spread(rows), "detail_id", "html")
    return found.select("detail_id", "source", "title", "company", "location_raw", "apply_url", F.array_join("sources", ",").alias("sources"), "parse_success")


@query
def card_records(spark, d):
    """Sightings written as search pages with cards and collected again: the first link of each posting."""
    rows = table(spark, d, "collected").select("seq", F.expr(BOARD_URLS).alias("link"), "title", "company")
    link = _markup(F.col("link"))
    page = F.concat(
        F.lit("<body><ul><li><h2> "), _markup(F.col("title")), F.lit("</h2><span class='jobCompany'>"), _markup(F.col("company")), F.lit("</span><a href='"), link,
        F.lit("'>Open</a></li><li><a href='"), link, F.lit("'>Again</a><a href='/help'>Help</a></li></ul></body>"),
    )
    pages = rows.select("seq", F.lit("https://search.example/").alias("page"), page.alias("html"))
    return html.collected_records(spread(pages), "seq", "page", "html").select("seq", "source", "url", "title", "company", F.col("position").cast("bigint").alias("position"))


@query
def usage_accounts(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_kind") == "advert").alias("hit"), F.col("n_chars").alias("total_tokens"), F.length("company").alias("prompt_tokens"))
    return scoring.accounts(rows, "hit", ["prompt_tokens", "total_tokens"])


@query
def latest_per_company(spark, d):
    rows = table(spark, d, "employer_feed").select("feed_id", "company", "posted_at")
    return ordering.per_group_top(rows, "company", [F.col("posted_at").desc_nulls_last(), F.col("feed_id")], 3)


@query
def ranked_orders(spark, d):
    """The hundred largest orders, ties by key."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ordering.cap_total(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


@query
def lines_interleaved(spark, d):
    """All order lines taken in turn from each supplier."""
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    found = ordering.interleave(rows, "l_suppkey", "line")
    return found.select("line", F.col("turn").cast("bigint").alias("turn"), "lane")


@query
def export_links(spark, d):
    best = t.first_filled(F.col("apply_url"), F.col("source_job_url"), F.col("url"))
    return table(spark, d, "parsed_detail").select("detail_id", F.coalesce(best, F.lit("")).alias("link"), t.joined(F.col("sources")).alias("role_source"))


@query
def export_splits(spark, d):
    rows = export.export_rows(table(spark, d, "parsed_detail"), "detail_id", F.lit(0))
    return export.split_counts(rows)


@query
def export_rows(spark, d):
    rows = export.export_rows(table(spark, d, "parsed_detail"), "detail_id", (F.col("detail_id") % 11).cast("bigint"))
    return rows.select("detail_id", F.col("Score").alias("score"), F.col("Role Type").alias("role_type"), F.col("Title").alias("title"), F.col("Apply Link").alias("link"))


def _json_rows(spark, d) -> DataFrame:
    return table(spark, d, "parsed_detail").select("detail_id", "title", "company", "sources", "parse_success")


@query
def jsonl_round_trip(spark, d):
    """Postings written as lines in order and read back, with a line that is no JSON beside them."""
    rows, path = _json_rows(spark, d), new_folder(spark, "lines")
    write_jsonl(rows, path, [F.col("detail_id")])
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return read_jsonl(spark, path, rows.schema).select("detail_id", "title", "company", F.array_join("sources", ",").alias("sources"), "parse_success")


@query
def run_export_round_trip(spark, d):
    """Sightings exported by run and counted from the export."""
    path = new_folder(spark, "runs")
    write_run(table(spark, d, "collected").select("run_id", "seq", "url", "title"), path)
    found = spark.read.schema("seq bigint, url string, title string, run_id bigint").json(path)
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"), F.count("title").alias("titled"))


@query
def queue_file_round_trip(spark, d):
    """The queue written as lines under its import names, and imported."""
    path = new_folder(spark, "queue")
    rows = table(spark, d, "queue_generated").select("source", "search_query", "search_location", F.col("page_number").alias("result_page_number"), "url")
    write_jsonl(rows, path)
    found = read_queue(spark, path)
    return found.groupBy("source", "query", "location", F.col("pageNumber").alias("page")).agg(F.count(F.lit(1)).alias("n"))


@query
def details_upserted(spark, d):
    """Postings that arrive in micro-batches, one per address as seen (or clean address)."""
    runs = Runs(spark, new_folder(spark, "runs"), run_id=1)
    rows = table(spark, d, "parsed_detail").select("detail_id", "url", "source_job_url", "title")
    path = new_folder(spark, "arriving")
    rows.repartition(3).write.parquet(path)
    runs.details.feed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), f"{runs.folder}/checkpoint").awaitTermination()
    found = runs.details.current().select(t.first_filled(F.col("source_job_url"), F.col("url")).alias("address"))
    return found.groupBy("address").agg(F.count(F.lit(1)).alias("n"))


@query
def export_widths(spark, d):
    rows = table(spark, d, "parsed_detail")
    return column_widths(rows, ["title", "company", "location_raw", "apply_url"])


@query
def user_activity(spark, d):
    """Events of each user: how many, of how many kinds, from when until when."""
    rows = table(spark, d, "events").groupBy("user_id")
    return rows.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("kinds"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def _stream(spark, d, name: str, *columns: str, files: int = 4) -> DataFrame:
    """A stream over some columns of a table, of several files that arrive one after the other."""
    path = new_folder(spark, "arriving")
    rows = table(spark, d, name).select(*columns)
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _fed_pool(spark, d) -> Pool:
    folder = new_folder(spark, "pool")
    pool = Pool(spark, folder, "url", "seq")
    pool.feed(_stream(spark, d, "collected", "url", "seq", "source"), f"{folder}/checkpoint").awaitTermination()
    return pool


@query
def stream_first_seen(spark, d):
    """The pool of a stream of sightings in several micro-batches: each posting once."""
    return _fed_pool(spark, d).current().select("url")


@query
def stream_totals(spark, d):
    """What the micro-batches of that stream found and added, altogether."""
    rows = _fed_pool(spark, d).statistics()
    return rows.agg(F.count_distinct("batch").alias("batches"), F.sum("found").alias("found"), F.sum("added").alias("added"))


def _shipped(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(function) for name, function in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
