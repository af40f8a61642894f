"""DuckDB SQL with the results of the core queries."""

from __future__ import annotations

from hirelake.functions.text import ENGLISH_MARKERS, GERMAN_MARKERS, NAVIGATION, NOISE_MARKERS, ROLE_WORDS, START_MARKERS, STOP_MARKERS
from hirelake.operators.excerpt import KEEP_HEADINGS, LEAST_CHARACTERS, MOST_CHARACTERS, SIGNALS, STOP_HEADINGS

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def collapse(v: str) -> str:
    return f"trim(regexp_replace({v}, '{SPACE}+', ' ', 'g'))"


def fold(v: str) -> str:
    out = f"lower(coalesce({v}, ''))"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def slug(v: str) -> str:
    return f"replace(replace(replace(lower({collapse(v)}), '+', 'plus'), '&', 'and'), ' ', '-')"


def lines(v: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({v}, ''), '{LINE_END}'), lambda x: {collapse('x')}), lambda x: x <> '')"


def clean_lines(v: str) -> str:
    return f"list_filter({lines(v)}, lambda x: NOT list_contains({listed(NAVIGATION)}, lower(x)))"


def strip(v: str) -> str:
    return f"regexp_replace({v}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def trim_description(v: str) -> str:
    start = "coalesce(" + ", ".join(f"nullif(strpos({v}, {quoted(m)}), 0)" for m in START_MARKERS) + ", 1)"
    tail = f"substr({v}, {start})"
    stops = ", ".join(f"CASE WHEN strpos({tail}, {quoted(m)}) > 1 THEN strpos({tail}, {quoted(m)}) END" for m in STOP_MARKERS)
    body = f"CASE WHEN least({stops}) IS NULL THEN {tail} ELSE left({tail}, least({stops}) - 1) END"
    return f"CASE WHEN {v} = '' THEN {v} ELSE coalesce(nullif({strip(body)}, ''), {v}) END"


def noise_steps(source: str, v: str) -> str:
    """CTEs n0, n1 ... each with the text cut at one more marker."""
    steps = [f"n0 AS (SELECT detail_id, {strip(v)} AS x FROM {source})"]
    for n, marker in enumerate(NOISE_MARKERS):
        at = f"strpos(x, {quoted(marker)})"
        steps.append(f"n{n + 1} AS (SELECT detail_id, CASE WHEN {at} > 1 THEN {strip(f'left(x, {at} - 1)')} ELSE x END AS x FROM n{n})")
    return ", ".join(steps)


def inferred(v: str) -> tuple[str, str]:
    chunk = f"lower(array_to_string(({clean_lines(v)})[1:45], ' '))"
    has = lambda *w: "(" + " OR ".join(f"contains({chunk}, '{x}')" for x in w) + ")"
    workplace = f"CASE WHEN {has('remote')} THEN 'remote' WHEN {has('hybrid')} THEN 'hybrid' WHEN {has('on-site', 'onsite', 'vor ort')} THEN 'on-site' END"
    employment = f"CASE WHEN {has('part-time', 'teilzeit')} THEN 'part-time' WHEN {has('full-time', 'vollzeit')} THEN 'full-time' WHEN {has('internship', 'praktikum')} THEN 'internship' END"
    return workplace, employment


def count_literals(v: str, words) -> str:
    return f"len(list_filter({listed(words)}, lambda w: contains({v}, w)))"


KEYWORDS = f"""list_concat(
    list_filter(list_transform(coalesce(search_queries, []), lambda x: {collapse('x')}), lambda x: x <> ''),
    list_filter(list_transform(flatten(list_transform(coalesce(search_urls, []), lambda z:
        flatten(list_transform(['keywords', 'q', 'what', 'was'], lambda n:
            list_transform(list_filter(string_split(regexp_extract(z, '\\?([^#]*)', 1), '&'), lambda p: starts_with(p, n || '=')),
                           lambda p: substr(p, len(n) + 2)))))), lambda x: trim(url_decode(replace(x, '+', ' ')))), lambda x: x <> ''))"""
UNIQUE_KEYWORDS = f"array_to_string(list_filter({KEYWORDS}, lambda x, i: list_position({KEYWORDS}, x) = i), '|')"

_RANKED = """WITH r AS (SELECT seq, source, search_query, min(seq) OVER (PARTITION BY source) AS source_rank FROM queue_generated),
    l AS (SELECT *, row_number() OVER (PARTITION BY source, search_query ORDER BY seq) AS turn, min(seq) OVER (PARTITION BY source, search_query) AS lane FROM r),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, lane) AS slot FROM l),
    a AS (SELECT * FROM c WHERE slot <= 40 ORDER BY source_rank, slot LIMIT 240)"""


def _excerpt(table: str, key: str, v: str) -> str:
    """Last heading event before each line decides; the same rule as the fold, as windows."""
    any_of = lambda words: "(" + " OR ".join(f"contains(f, {quoted(w)})" for w in dict.fromkeys(words)) + ")"
    return f"""WITH l AS (SELECT {key}, {lines(v)} AS ls FROM {table}),
    x AS (SELECT {key}, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
    y AS (SELECT *, {fold('line')} AS f FROM x),
    z AS (SELECT *, length(line) <= 90 AND {any_of(KEEP_HEADINGS)} AS keep, length(line) <= 90 AND {any_of(STOP_HEADINGS)} AS halt, {any_of(SIGNALS)} AS signal FROM y),
    s AS (SELECT *, coalesce(bool_or(keep) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS seen FROM z),
    e AS (SELECT *, CASE WHEN keep THEN 1 WHEN halt AND seen THEN 0 END AS event FROM s),
    k AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS inside FROM e),
    g AS (SELECT {key}, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE inside = 1 OR (coalesce(event, 1) = 1 AND signal)) AS kept FROM k GROUP BY {key}),
    b AS (SELECT l.{key}, CASE WHEN length(coalesce(g.kept, '')) < {LEAST_CHARACTERS} THEN array_to_string(l.ls, chr(10)) ELSE g.kept END AS body
          FROM l LEFT JOIN g USING ({key}))"""


def _board_urls(v: str = "url") -> str:
    return f"""CASE seq % 8
    WHEN 0 THEN 'https://de.indeed.com/viewjob?from=x&jk=k' || (seq % 50)
    WHEN 1 THEN 'https://www.linkedin.com/jobs/view/' || (seq % 50) || '/?trk=a#b'
    WHEN 2 THEN 'https://www.stepstone.de/stellenangebote--data-' || (seq % 50) || '.html?rltr=1'
    WHEN 3 THEN 'https://www.xing.com/jobs/data-' || (seq % 50) || '/'
    WHEN 4 THEN 'https://www.arbeitsagentur.de/jobsuche/jobdetail/' || (seq % 50) || '#top'
    WHEN 5 THEN 'https://www.stellenwerk.de/mainz/job-' || (seq % 50)
    WHEN 6 THEN 'https://www.xing.com/jobs/search?keywords=' || (seq % 50)
    ELSE {v} END"""


CLEAN_URL = r"CASE WHEN regexp_matches({v}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN regexp_replace(regexp_replace({v}, '[?#].*$', ''), '/$', '') END"
_WORD_EDGE = r"[^\p{L}\p{N}_]"
_ROLE = "CASE " + " ".join(
    f"WHEN regexp_matches(x, '(^|{_WORD_EDGE})({words})({_WORD_EDGE}|$)') THEN '{label}'" for label, words in ROLE_WORDS
) + " WHEN contains(e, 'full') OR contains(e, 'vollzeit') THEN 'full_time_or_regular' WHEN contains(e, 'part') OR contains(e, 'teilzeit') THEN 'part_time_regular' ELSE 'other' END"
_FILLED = "coalesce({0} <> '', false)"
_MARKED = "concat_ws(chr(10), 'Deine Aufgaben', description_raw, 'Weitere Jobs you may like')"
_HEAD = "concat_ws(chr(10), coalesce(company, 'Firma'), coalesce(source, 'x'), 'Ort · ' || detail_id || ' days ago', description_raw)"
_WORKPLACE, _EMPLOYMENT = inferred("description_raw")
_VOTE = fold("concat_ws(chr(10), text, ['', 'Wir suchen dich. Deine Aufgaben', 'About the role: requirements', 'Studium und requirements', 'Kenntnisse'][doc_id % 5 + 1])")

ORACLES = {
    "sightings_by_source": "SELECT source, count(*) AS sightings, count(DISTINCT url) AS postings FROM collected GROUP BY source",
    "dedup_first_wins": "SELECT url, seq, source, title FROM collected WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1",
    "merge_pool": """WITH o AS (SELECT url, min(seq) AS seq, arg_max(coalesce(title, chr(0)), seq) AS title FROM collected WHERE result_page_number = 1 GROUP BY url),
        n AS (SELECT url, seq, title FROM collected WHERE result_page_number IS DISTINCT FROM 1 AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
        SELECT url, seq, nullif(title, chr(0)) AS title FROM o UNION ALL SELECT * FROM n WHERE url NOT IN (SELECT url FROM o WHERE url IS NOT NULL)""",
    "merge_by_key_expression": "SELECT detail_id, url, source_job_url, title FROM parsed_detail QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(source_job_url, ''), nullif(url, '')) ORDER BY detail_id) = 1",
    "page_stats": "SELECT run_id, search_url, count(*) AS found, count(DISTINCT url) AS distinct_urls, count(*) FILTER (WHERE title IS NULL) AS untitled FROM collected GROUP BY run_id, search_url",
    "pool_totals": """WITH f AS (SELECT url, min(run_id) AS run_id FROM collected WHERE url IS NOT NULL GROUP BY url), a AS (SELECT run_id, count(*) AS added FROM f GROUP BY run_id)
        SELECT c.run_id, count(*) AS n, count(DISTINCT url) AS urls, coalesce(any_value(a.added), 0) AS added FROM collected c LEFT JOIN a USING (run_id) WHERE url IS NOT NULL GROUP BY c.run_id""",
    "pages_without_sightings": "SELECT seq, url FROM queue_generated q WHERE NOT EXISTS (SELECT 1 FROM collected c WHERE c.search_url = q.url)",
    "queue_distinct_queries": f"SELECT search_query, seq FROM (SELECT {collapse('search_query')} AS search_query, seq FROM queue_generated) WHERE search_query <> '' QUALIFY row_number() OVER (PARTITION BY lower(search_query) ORDER BY seq) = 1",
    "queue_interleaved": "SELECT seq, row_number() OVER (PARTITION BY search_query ORDER BY seq) AS turn, min(seq) OVER (PARTITION BY search_query) AS lane FROM queue_generated",
    "queue_cap_per_source": "SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS position FROM queue_generated QUALIFY position <= 40",
    "queue_fair": f"{_RANKED} SELECT row_number() OVER (ORDER BY slot, source_rank) AS place, seq, source FROM a",
    "queue_counts": "SELECT source, query_group, count(*) AS n FROM queue_generated GROUP BY source, query_group",
    "queue_grid": f"""WITH q AS (SELECT min_by(x, seq) AS query FROM (SELECT {collapse('search_query')} AS x, seq FROM queue_generated) WHERE x <> '' GROUP BY lower(x)),
        l AS (SELECT min_by(x, seq) AS location FROM (SELECT {collapse('search_location')} AS x, seq FROM queue_generated) WHERE x <> '' GROUP BY lower(x)),
        g AS (SELECT query, location, replace(url_encode(query), '%20', '+') AS qp, replace(url_encode(location), '%20', '+') AS lp, {slug('query')} AS qs, {slug('location')} AS ls FROM q, l)
        SELECT 'indeed' AS source, query, location, p AS page_number, 'https://a.example/jobs?q=' || qp || '&l=' || lp || CASE WHEN p = 2 THEN '&start=10' ELSE '' END AS url FROM g, (VALUES (1), (2)) t(p)
        UNION ALL SELECT 'stepstone', query, location, p, 'https://b.example/jobs/' || qs || '/in-' || ls || CASE WHEN p = 2 THEN '?page=2' ELSE '' END FROM g, (VALUES (1), (2)) t(p)
        UNION ALL SELECT 'arbeitsagentur', query, location, 1, 'https://c.example/suche?was=' || replace(url_encode(query), '%2F', '/') FROM g WHERE location IN ('Zwistbach', 'Löppbach')""",
    "queue_planned": f"""WITH q AS (SELECT min_by(x, seq) AS query, min(seq) AS qn FROM (SELECT {collapse('search_query')} AS x, seq FROM queue_generated) WHERE x <> '' GROUP BY lower(x)),
        l AS (SELECT min_by(x, seq) AS location, min(seq) AS ln FROM (SELECT {collapse('search_location')} AS x, seq FROM queue_generated) WHERE x <> '' GROUP BY lower(x)),
        e AS (SELECT *, replace(url_encode(query), '%20', '+') AS qp, replace(url_encode(location), '%20', '+') AS lp FROM q, l),
        g AS (SELECT 0 AS r, 'indeed' AS source, 'Indeed' AS source_name, query, location, qn, ln, p AS page_number,
                 'https://i.example/' || CASE location WHEN 'Zwistbach' THEN 'zw' ELSE {slug('location')} END || '?q=' || qp || '&r=30' || CASE p WHEN 2 THEN '&start=10' ELSE '' END AS url
              FROM e, (VALUES (1), (2)) t(p) WHERE location IN ('Zwistbach', 'Löppbach')
              UNION ALL SELECT 1, 'xing', 'xing', query, location, qn, ln, 1, 'https://x.example/jobs?k=' || qp || '&l=' || lp || '&age=7' FROM e),
        t AS (SELECT *, row_number() OVER (PARTITION BY r, query, location ORDER BY page_number) AS turn FROM g),
        c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY turn, qn, ln) AS slot FROM t QUALIFY slot <= 30 ORDER BY r, slot LIMIT 50)
        SELECT row_number() OVER (ORDER BY slot, r) AS place, source, source_name, query, location, page_number, url FROM c""",
    "slugs": f"SELECT DISTINCT search_query, search_location, {slug('search_query')} AS query_slug, {slug('search_location')} AS location_slug FROM queue_generated",
    "posting_domains": r"SELECT CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '') END AS domain, count(*) AS n FROM collected GROUP BY 1",
    "urls_without_tracking": f"SELECT detail_id, {CLEAN_URL.format(v='source_job_url')} AS clean, regexp_replace(source_job_url, '#.*$', '') AS page FROM parsed_detail",
    "board_postings": f"""WITH j AS (SELECT seq, {_board_urls()} AS x FROM collected),
        b AS (SELECT seq, x, CASE WHEN contains(x, 'linkedin.com/jobs/view/') THEN 'linkedin' WHEN contains(x, 'indeed.com/viewjob') THEN 'indeed' WHEN contains(x, 'stepstone.de/stellenangebote--') THEN 'stepstone'
            WHEN contains(x, 'xing.com/jobs/') AND NOT contains(x, 'xing.com/jobs/search') THEN 'xing' WHEN contains(x, 'arbeitsagentur.de/jobsuche/jobdetail/') THEN 'arbeitsagentur' WHEN contains(x, 'stellenwerk.de/mainz/') THEN 'stellenwerk' END AS board FROM j)
        SELECT seq, board, CASE board WHEN 'indeed' THEN 'https://de.indeed.com/viewjob?jk=' || regexp_extract(x, 'jk=([^&#]+)', 1) WHEN 'linkedin' THEN 'https://www.linkedin.com/jobs/view/' || regexp_extract(x, '/view/([^/?#]+)', 1)
            WHEN NULL THEN NULL ELSE CASE WHEN board IS NOT NULL THEN {CLEAN_URL.format(v='x')} END END AS posting FROM b""",
    "board_pages": f"""WITH b AS (SELECT seq, page_number AS p, ['indeed', 'linkedin', 'stepstone', 'xing', 'arbeitsagentur', 'stellenwerk'][seq % 6 + 1] AS board, {CLEAN_URL.format(v='url')} AS base FROM queue_generated)
        SELECT seq, CASE WHEN p <= 1 THEN base WHEN board = 'indeed' THEN base || '?start=' || (p - 1) * 10 WHEN board = 'linkedin' THEN base || '?start=' || (p - 1) * 25 WHEN board IN ('stepstone', 'xing') THEN base || '?page=' || p
            WHEN board = 'stellenwerk' THEN base || '?pagination%5Bstart%5D=' || (p - 1) * 10 ELSE base END AS page_url FROM b""",
    "apply_urls_allowed": "SELECT source, coalesce(apply_url <> '', false) AND NOT contains(coalesce(apply_url, ''), '/safety/go') AND NOT contains(coalesce(regexp_extract(apply_url, '://([^/?#]+)', 1), ''), source || '.example') AS allowed, count(*) AS n FROM parsed_detail GROUP BY 1, 2",
    "search_keywords": f"SELECT detail_id, {UNIQUE_KEYWORDS} AS keywords FROM parsed_detail",
    "normalised_texts": f"SELECT detail_id, md5({collapse(fold('description_raw'))}) AS digest, {collapse(fold('title'))} AS title FROM parsed_detail",
    "cleaned_lines": f"SELECT detail_id, len({clean_lines('description_raw')}) AS n, md5(array_to_string({clean_lines('description_raw')}, chr(10))) AS digest FROM parsed_detail",
    "trimmed_descriptions": f"WITH p AS (SELECT detail_id, description_raw, {_MARKED} AS m FROM parsed_detail), {noise_steps('p', 'm')} SELECT p.detail_id, md5({trim_description('description_raw')}) AS plain, md5({trim_description('m')}) AS marked, md5(nullif(x, '')) AS noise FROM p JOIN n{len(NOISE_MARKERS)} USING (detail_id)",
    "inferred_types": f"SELECT detail_id, {_WORKPLACE} AS workplace, {_EMPLOYMENT} AS employment FROM parsed_detail",
    "normalised_records": f"""SELECT detail_id, coalesce(nullif(url, ''), nullif(source_job_url, '')) AS url, array_to_string(CASE WHEN len(sources) > 0 THEN sources WHEN source <> '' THEN [source] ELSE [] END, ',') AS sources,
        coalesce(nullif(workplace_type_raw, ''), {_WORKPLACE}) AS workplace_type_raw, coalesce(nullif(employment_type_raw, ''), {_EMPLOYMENT}) AS employment_type_raw, {UNIQUE_KEYWORDS} AS search_keywords FROM parsed_detail""",
    "header_repair": f"""WITH h AS (SELECT detail_id, {clean_lines(_HEAD)} AS l FROM parsed_detail),
        i AS (SELECT detail_id, l, list_position(list_transform(l, lambda x: regexp_matches(lower(x), ' ago|reposted|clicked apply') AND contains(x, '·')), true) AS k FROM h)
        SELECT detail_id, CASE WHEN k >= 3 THEN l[k - 2] END AS company, CASE WHEN k >= 3 THEN l[k - 1] END AS title, CASE WHEN k >= 3 THEN l[k] END AS location FROM i""",
    "parse_counts": f"""WITH p AS (SELECT source, {" OR ".join(_FILLED.format(c) for c in ("title", "company", "location_raw", "description_raw"))} AS ok FROM parsed_detail)
        SELECT source, count(*) AS parsed, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed FROM p GROUP BY source""",
    "section_excerpts": f"{_excerpt('parsed_detail', 'detail_id', 'description_raw')} SELECT detail_id, md5(body) AS digest FROM b",
    "compact_descriptions": f"""{_excerpt('documents', 'doc_id', 'text')}, c AS (SELECT b.doc_id, CASE WHEN d.text <> '' THEN CASE WHEN length(body) <= {MOST_CHARACTERS} THEN body
        WHEN contains(left(body, {MOST_CHARACTERS}), chr(10)) THEN regexp_replace(left(body, {MOST_CHARACTERS}), '\\n[^\\n]*$', '') ELSE left(body, {MOST_CHARACTERS}) END END AS c FROM b JOIN documents d USING (doc_id))
        SELECT doc_id, length(c) AS n, md5(c) AS digest FROM c""",
    "candidate_ids": "SELECT detail_id, printf('job_%04d', row_number() OVER (ORDER BY detail_id)) AS candidate_id FROM parsed_detail WHERE parse_success",
    "numbered_lines": "SELECT l_orderkey, l_linenumber, printf('line_%06d', row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)) AS line_id FROM lineitem",
    "role_kinds": f"SELECT {_ROLE} AS role_kind, count(*) AS n FROM (SELECT lower(concat_ws(' ', title, employment_type_raw)) AS x, lower(coalesce(employment_type_raw, '')) AS e FROM parsed_detail) GROUP BY 1",
    "marker_votes": f"""WITH v AS (SELECT lang, {collapse(_VOTE)} AS x FROM documents), c AS (SELECT lang, {count_literals('x', GERMAN_MARKERS)} AS g, {count_literals('x', ENGLISH_MARKERS)} AS e FROM v)
        SELECT lang, CASE WHEN g > e AND g >= 2 THEN 'german' WHEN e > g AND e >= 2 THEN 'english' ELSE 'mixed_or_unknown' END AS vote, count(*) AS n FROM c GROUP BY 1, 2""",
    "first_matches": f"""WITH v AS (SELECT {collapse(fold('text'))} AS x FROM documents)
        SELECT list_filter(['python', 'sql', 'java', 'daten', 'data'], lambda w: contains(x, w))[1] AS literal,
               CASE WHEN regexp_matches(x, '[0-9]+ (monaten|months)') THEN '[0-9]+ (monaten|months)' WHEN regexp_matches(x, 'haus [0-9]+') THEN 'haus [0-9]+' WHEN regexp_matches(x, 'building [0-9]+') THEN 'building [0-9]+' END AS pattern, count(*) AS n
        FROM v GROUP BY 1, 2""",
    "answers_parsed": "SELECT detail_id, k NOT IN (9, 10) AS is_object, CASE k WHEN 0 THEN 8 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 4 THEN 1 WHEN 8 THEN 10 WHEN 9 THEN NULL WHEN 10 THEN NULL ELSE 0 END AS score, CASE WHEN k = 0 THEN 'a,b,c,d,e' ELSE '' END AS tags FROM (SELECT detail_id, detail_id % 11 AS k FROM parsed_detail)",
    "request_keys": "SELECT detail_id, sha256(concat_ws(chr(31), 'model', 'profile', 'company', coalesce(company, ''), 'source_job_url', coalesce(source_job_url, ''), 'title', coalesce(title, ''), '2')) AS key FROM parsed_detail",
    "cache_hits_and_misses": """WITH k AS (SELECT source, concat_ws(chr(31), coalesce(company, ''), coalesce(source_job_url, ''), coalesce(title, '')) AS key FROM parsed_detail)
        SELECT source, key IN (SELECT key FROM k WHERE source = 'talentora') AS hit, count(*) AS n FROM k GROUP BY 1, 2""",
    "scored_postings": """WITH a AS (SELECT detail_id, detail_id % 11 AS k, detail_id % 7 <> 0 AS there FROM parsed_detail),
        b AS (SELECT *, there AND k NOT IN (9, 10) AS ok FROM a)
        SELECT detail_id, CASE WHEN ok THEN CASE k WHEN 0 THEN 8 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 4 THEN 1 WHEN 8 THEN 10 ELSE 0 END END AS llm_score,
            CASE WHEN NOT ok THEN 'llm_error' WHEN k IN (0, 1) THEN 'target' WHEN k = 5 THEN 'other' WHEN k = 8 THEN 'alternative' ELSE '' END AS llm_category,
            CASE WHEN ok AND k = 0 THEN 5 ELSE 0 END AS tags, there AND detail_id % 5 = 0 AS llm_cache_hit, NOT ok AS failed,
            CASE WHEN there THEN [101, 49, 41, 16, 15, 36, 14, 13, 40, 9, 6][k + 1] ELSE 0 END AS completion_tokens FROM b""",
    "cache_round_trip": "SELECT true AS cache_hit, count(*) AS n, 0 AS errors FROM employer_feed",
    "detail_pages": f"""SELECT detail_id, ['linkedin', 'indeed', 'stepstone', 'xing', 'arbeitsagentur', 'stellenwerk'][detail_id % 6 + 1] AS source,
            coalesce(nullif({collapse('title')}, ''), 'Title of the search page') AS title, nullif({collapse('company')}, '') AS company, nullif({collapse('location_raw')}, '') AS location_raw,
            nullif(apply_url, '') AS apply_url, ['linkedin', 'indeed', 'stepstone', 'xing', 'arbeitsagentur', 'stellenwerk'][detail_id % 6 + 1] AS sources, true AS parse_success FROM parsed_detail""",
    "card_records": "",
    "usage_accounts": "SELECT coalesce(doc_kind = 'advert', false) AS hit, count(*) AS answers, coalesce(sum(length(company)), 0)::BIGINT AS prompt_tokens, coalesce(sum(n_chars), 0)::BIGINT AS total_tokens FROM documents GROUP BY 1",
    "latest_per_company": "SELECT feed_id, company, posted_at FROM employer_feed QUALIFY row_number() OVER (PARTITION BY company ORDER BY posted_at DESC NULLS LAST, feed_id) <= 3",
    "ranked_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "lines_interleaved": "SELECT line, row_number() OVER (PARTITION BY l_suppkey ORDER BY line) AS turn, min(line) OVER (PARTITION BY l_suppkey) AS lane FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line FROM lineitem)",
    "export_links": "SELECT detail_id, coalesce(nullif(apply_url, ''), nullif(source_job_url, ''), nullif(url, ''), '') AS link, array_to_string(list_filter(sources, lambda x: x IS NOT NULL AND x <> ''), ', ') AS role_source FROM parsed_detail",
    "export_splits": f"""WITH k AS (SELECT {_ROLE} AS kind FROM (SELECT lower(concat_ws(' ', title, employment_type_raw, description_raw)) AS x, lower(coalesce(employment_type_raw, '')) AS e FROM parsed_detail)),
        b(workbook, kinds) AS (VALUES ('all', NULL), ('internship', ['internship']), ('working_student', ['working_student']), ('thesis', ['thesis']), ('hiwi', ['hiwi']), ('regular_or_other', ['full_time_or_regular', 'part_time_regular', 'other']))
        SELECT workbook, (SELECT count(*) FROM k WHERE kinds IS NULL OR list_contains(kinds, kind)) AS n FROM b""",
    "export_rows": f"""SELECT detail_id, detail_id % 11 AS score, {_ROLE} AS role_type, title, link FROM (SELECT detail_id, coalesce({strip('title')}, '') AS title, coalesce(nullif(apply_url, ''), nullif(source_job_url, ''), nullif(url, ''), '') AS link,
        lower(concat_ws(' ', title, employment_type_raw, description_raw)) AS x, lower(coalesce(employment_type_raw, '')) AS e FROM parsed_detail)""",
    "jsonl_round_trip": "SELECT detail_id, title, company, array_to_string(sources, ',') AS sources, parse_success FROM parsed_detail",
    "run_export_round_trip": "SELECT run_id, count(*) AS n, count(DISTINCT url) AS urls, count(title) AS titled FROM collected GROUP BY run_id",
    "queue_file_round_trip": """SELECT source, search_query AS query, search_location AS location, coalesce(nullif(page_number, 0), 1) AS page, count(*) AS n FROM queue_generated
        WHERE url <> '' AND source <> '' GROUP BY ALL""",
    "details_upserted": "SELECT DISTINCT coalesce(nullif(source_job_url, ''), nullif(url, '')) AS address, 1 AS n FROM parsed_detail WHERE coalesce(nullif(source_job_url, ''), nullif(url, '')) IS NOT NULL",
    "export_widths": "SELECT c AS \"column\", greatest(10, least(42, greatest(coalesce(n, 0), length(c)) + 2)) AS width FROM (SELECT unnest(['title', 'company', 'location_raw', 'apply_url']) AS c, unnest([max(length(title)), max(length(company)), max(length(location_raw)), max(length(apply_url))]) AS n FROM parsed_detail)",
    "user_activity": "SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id",
    "stream_totals": "SELECT 4 AS batches, count(*) AS found, count(DISTINCT url) AS added FROM collected",
    "stream_first_seen": "SELECT DISTINCT url FROM collected WHERE url IS NOT NULL",
}
ORACLES["card_records"] = f"""WITH p AS ({ORACLES["board_postings"]})
    SELECT seq, board AS source, posting AS url, coalesce(nullif({collapse('title')}, ''), 'Open') AS title, nullif({collapse('company')}, '') AS company, 0 AS position
    FROM p JOIN collected USING (seq) WHERE board IS NOT NULL AND posting IS NOT NULL"""
