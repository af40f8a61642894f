import json

import pytest

from hirelake import cli
from hirelake.operators import queue

PLACES = ["Darmstadt", "Frankfurt am Main", "Mainz", "Wiesbaden", "Heidelberg"]
SEARCH = "?q={query_plus}&l={location_plus}"
CONFIG = {
    "query_generation": {
        "active_locations": PLACES,
        "explicit_queries": ["Werkstudent Softwareentwicklung", "Working Student Software", *(f"Query {n}" for n in range(18))],
        "query_groups": {name: [f"{name} {n}" for n in range(size)] for name, size in
                         (("working_student", 15), ("internship", 12), ("hiwi", 6), ("thesis", 6), ("expanded_today", 26))},
    },
    "sources": {
        "linkedin": {"enabled": True, "url_template": "https://www.linkedin.com/jobs/search/" + SEARCH},
        "indeed": {"enabled": True, "display_name": "Indeed Germany", "url_template": "https://de.indeed.com/jobs" + SEARCH},
        "stepstone": {"enabled": True, "url_template": "https://www.stepstone.de/jobs" + SEARCH},
        "xing": {"enabled": True, "url_template": "https://www.xing.com/jobs/search" + SEARCH},
        "arbeitsagentur": {"enabled": True, "url_template": "https://www.arbeitsagentur.de/jobsuche/suche" + SEARCH, "max_pages_per_search": 1},
        "stellenwerk": {"enabled": True, "url_template": "https://www.stellenwerk.de/{location_slug}?_q={query_plus}",
                        "supported_locations": ["Darmstadt", "Frankfurt", "Mainz", "Wiesbaden", "Heidelberg"],
                        "location_slug_overrides": {"Mainz": "mainz-am-rhein"}},
    },
    "run_safety": {"max_urls_per_source": 40, "max_total_urls": 240, "max_pages_per_search": 2},
    "discovery": {"source_order": ["indeed", "stepstone", "linkedin", "xing", "arbeitsagentur", "stellenwerk"]},
}
ORDER = CONFIG["discovery"]["source_order"]


@pytest.mark.parametrize(
    "plan, counts",
    [
        (queue.Plan(), dict.fromkeys(ORDER, 40)),
        (queue.Plan("working_student"), dict.fromkeys(ORDER, 40)),
        (queue.Plan("internship"), dict.fromkeys(ORDER, 40)),
        (queue.Plan("hiwi"), dict.fromkeys(ORDER, 40) | {"arbeitsagentur": 30}),
        (queue.Plan("thesis"), dict.fromkeys(ORDER, 40) | {"arbeitsagentur": 30}),
        (queue.Plan("expanded_today", ["indeed", "stepstone", "linkedin", "xing"], pages=3, per_source=400, total=1600), dict.fromkeys(ORDER[:4], 390)),
        (queue.Plan(total=100), {"indeed": 40, "stepstone": 40, "linkedin": 20}),
        (queue.Plan("hiwi", pages=3, per_source=400, total=1600), dict.fromkeys(ORDER, 90) | {"stellenwerk": 72}),
    ],
)
def test_counts_by_source(spark, plan, counts):
    rows = queue.planned_queue(spark, CONFIG, plan=plan).collect()
    got = {}
    for r in rows:
        got[r["source"]] = got.get(r["source"], 0) + 1
    assert got == counts
    assert sorted(r["place"] for r in rows) == list(range(1, len(rows) + 1))
    assert {r["query_group"] for r in rows} == {plan.group or "all"}


def test_order_slugs_and_pages(spark):
    rows = queue.planned_queue(spark, CONFIG).orderBy("place").collect()
    assert [r["source"] for r in rows[:7]] == [*ORDER, "indeed"]
    assert {(r["query"], r["location"], r["page_number"]) for r in rows[:6]} == {("Werkstudent Softwareentwicklung", "Darmstadt", 1)}
    assert (rows[6]["query"], rows[6]["location"]) == ("Werkstudent Softwareentwicklung", "Frankfurt am Main")
    assert rows[0]["source_name"] == "Indeed Germany" and rows[1]["source_name"] == "stepstone"
    assert any(r["url"].startswith("https://www.stellenwerk.de/mainz-am-rhein?") for r in rows)
    hiwi = queue.planned_queue(spark, CONFIG, plan=queue.Plan("hiwi", pages=3, per_source=400, total=1600)).where("source = 'arbeitsagentur'")
    assert hiwi.select("url").distinct().count() == 30


def test_query_texts_and_locations():
    profile = {"target_search": {"primary_locations": ["Ulm", "ulm "], "role_types": [{"labels": ["A", "B"]}, {"labels": []}, {"labels": ["a", "C"]}]}}
    terms = {"focus_terms": ["x", "X", "y"], "templates": ["{role} only", "{role} {focus}"]}
    assert queue.query_texts({"query_generation": terms}, profile=profile) == ["A", "A x", "A y", "B", "B x", "B y", "C", "C x", "C y"]
    first = terms | {"role_label_mode": "first_label", "include_role_only_queries": False}
    assert queue.query_texts({"query_generation": first}, profile=profile) == ["A x", "A y"]
    with pytest.raises(ValueError, match="hiwi"):
        queue.query_texts(CONFIG, "nope")
    assert queue.plan_locations(CONFIG, profile, queue.Plan(profile_locations=True)) == ["Ulm"]
    assert queue.plan_locations(CONFIG, profile, queue.Plan(locations=["Bremen"])) == ["Bremen"]


def test_query_independent_sources(spark):
    config = {"query_generation": {"explicit_queries": ["a", "b"], "active_locations": ["Ulm", "Bremen"]},
              "sources": {"s": {"enabled": True, "query_independent": True, "url_template": "https://s.example/{query}/{sort}/{location}"}}}
    assert {r["url"] for r in queue.planned_queue(spark, config).collect()} == {"https://s.example/all/date/Ulm", "https://s.example/all/date/Bremen"}


def test_command_line_writes_both_outputs(spark, tmp_path):
    import yaml

    outputs = {"json": str(tmp_path / "queue.json"), "jsonl": str(tmp_path / "queue.jsonl")}
    config = CONFIG | {"run_safety": CONFIG["run_safety"] | {"write_outputs": outputs, "max_total_urls": 12}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config, sort_keys=False))
    cli.main(["queue", str(tmp_path / "c.yaml"), "--query-group", "hiwi", "--sources", "indeed,xing"])
    found = json.loads((tmp_path / "queue_hiwi.json").read_text())
    lines = spark.read.json(str(tmp_path / "queue_hiwi.jsonl"))
    assert len(found) == lines.count() == 12 and found[0]["queryGroup"] == "hiwi" and found[0]["pageNumber"] == 1
    assert {"place", "source", "source_name", "query", "location", "pageNumber", "url", "generated_at", "queryGroup"} == set(lines.columns)
