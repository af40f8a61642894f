import json

import pytest
from pyspark.sql import functions as F

from hirelake.operators import scoring
from hirelake.sources import html


@pytest.mark.parametrize(
    "selector, found",
    [
        ("p", ["a", "b"]), (".x", ["a", "c"]), ("p.x", ["a"]), ("#k", ["b"]), ("[data-t]", ["c"]), ("[data-t='v w']", ["c"]), ("[data-t*=' w']", ["c"]),
        ("div p", ["a", "b"]), ("section p", ["b"]), ("section .x", []), ("div section p", ["b"]), ("a[href*='/q']", ["d"]), ("a[href][class*='x']", []),
    ],
)
def test_selectors(selector, found):
    page = html._read("<div><p class='x y'>a</p><section><p id=k>b</p></section></div><i class=x data-t='v w'>c</i><a href='/q/1'>d</a>")
    assert html.all_texts(page.elements, (selector,)) == found


def test_detail_precedence_and_fallbacks(spark):
    long = "word " * 30
    body = "<h1> The  job </h1><div class='jobsearch-jobDescriptionText'>short</div><div id='jobDescriptionText'>%s</div>"
    apply = "<a href='https://de.indeed.com/apply' aria-label='Apply'>x</a><a href='https://firm.example/start' id='apply-2'>y</a><a href='/z'>Jetzt bewerben</a>"
    pages = [
        (1, "https://de.indeed.com/viewjob?jk=1", body % long + apply, "S", None, "q", "u"),
        (2, "https://de.indeed.com/viewjob?jk=2", f"<body>{body % 'little'}Similar jobs and more</body>", None, "C", None, ""),
        (3, None, None, None, None, None, None),
        (4, "https://de.indeed.com/viewjob?jk=4", "<a href='/safety/go?x'>Apply</a><a href='https://o.example/b'>Zur Bewerbung</a>", None, None, None, None),
    ]
    rows = spark.createDataFrame(pages, "id bigint, url string, html string, title string, company string, search_query string, search_url string")
    got = {r["id"]: r for r in html.detail_records(rows, "id", "html").collect()}
    assert (got[1]["title"], got[1]["source"], got[1]["sources"]) == ("The job", "indeed", ["indeed"])
    assert got[1]["description_raw"] == long.strip() and got[1]["apply_url"] == "https://firm.example/start"
    assert got[1]["search_queries"] == ["q"] and got[1]["search_urls"] == ["u"] and got[2]["search_urls"] == []
    assert got[2]["description_raw"] == "The job\nshort\nlittle" and got[2]["company"] == "C" and got[2]["apply_url"] is None
    assert not got[3]["parse_success"] and got[3]["source"] == "unknown" and got[3]["description_raw"] is None
    assert got[4]["apply_url"] == "https://o.example/b"


def test_cards_take_the_closest_container(spark):
    page = (
        "<article><h3>First</h3><a href='https://www.xing.com/jobs/a-1?x=1'>Open</a><p class='myCompany'>Firm</p></article>"
        "<a href='https://www.xing.com/jobs/a-1#again'>First again</a><span><a href='https://www.xing.com/jobs/b-2/'> Second </a></span>"
        "<a href='https://www.linkedin.com/jobs/view/7/'>Other board</a><a href='mailto:x'>m</a><a>none</a>"
    )
    rows = spark.createDataFrame([(1, "https://www.xing.com/jobs/search", page, "xing"), (2, None, None, None)], "id bigint, url string, html string, source string")
    got = html.collected_records(rows, "id", "url", "html", "source").orderBy("position").collect()
    assert [(r["url"], r["title"], r["company"]) for r in got] == [("https://www.xing.com/jobs/a-1", "First", "Firm"), ("https://www.xing.com/jobs/b-2", "Second", None)]
    assert html.collected_records(rows, "id", "url", "html").count() == 3


def test_chat_answers_are_unwrapped(spark):
    content = lambda x, **more: json.dumps({"choices": [{"message": {"content": x} | more}], "usage": {"total_tokens": 7}})
    bodies = [content('{"score": 1}'), content("", reasoning_content="hm"), content("no"), "<html>", '{"choices": []}', None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").select("id", scoring.unwrapped(F.col("body")).alias("u"))
    got = {r["id"]: r["u"] for r in rows.collect()}
    assert got[0]["content"] == '{"score": 1}' and got[0]["usage"]["total_tokens"] == 7 and got[0]["usage"]["prompt_tokens"] == 0
    assert [got[n]["error"].split(":")[0] for n in (1, 2, 3, 4)] == ["empty content beside reasoning", "no object", "no JSON", "no message"]
    assert got[0]["error"] is None and got[5]["error"] is None and got[5]["content"] is None


def test_service_and_prompt(spark):
    service = scoring.Service("https://s.example/v1/", "m", "system", key="secret")
    assert "secret" not in repr(service) and service.payload("p")["messages"][1] == {"role": "user", "content": "p"}
    row = spark.createDataFrame([("T", None)], "title string, company string").select(scoring.prompt_of("a: ä\n", F.struct("title", "company"), "Decide.").alias("p"))
    assert json.loads(row.first()["p"]) == {"candidate_profile_yaml": "a: ä\n", "job": {"title": "T", "company": None}, "task": "Decide."}


def test_answers_are_cached_and_failures_are_not(spark, tmp_path):
    path = str(tmp_path / "cache")

    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return json.dumps({"choices": [{"message": {"content": '{"score": 3, "reason": "%s"}' % ("r" * 300)}}]})

    rows = spark.createDataFrame([("1", "good"), ("2", "bad"), ("1", "good")], "key string, prompt string")
    first = scoring.answered(rows, path, client, sleep=lambda s: None)
    assert {(r["key"], r["cache_hit"], r["error"]) for r in first.collect()} == {("1", False, None), ("2", False, "RuntimeError: no")}
    again = scoring.answered(rows, path, client, sleep=lambda s: None)
    assert {(r["key"], r["cache_hit"]) for r in again.collect()} == {("1", True), ("2", False)}
    scored = scoring.scored_rows(spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "key string, title string"), again, "m")
    got = {r["title"]: r for r in scored.collect()}
    assert (got["a"]["llm_score"], len(got["a"]["llm_reason"]), got["a"]["llm_category"]) == (3, 240, "")
    assert (got["b"]["llm_score"], got["b"]["llm_category"], got["b"]["llm_reason"]) == (None, "llm_error", "llm_error: RuntimeError: no")
    assert {(r["title"], r["error"]) for r in scoring.errors(scored, "title").collect()} == {("b", "RuntimeError: no"), ("c", "no answer")}
