import zipfile

from pyspark.sql import functions as F

from hirelake.operators import export, queue

FIELDS = "detail_id bigint, title string, company string, location_raw string, employment_type_raw string, description_raw string, apply_url string, source_job_url string, url string, sources array<string>"


def test_splits_hold_every_row(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "Praktikum A", "F", None, None, None, None, "https://s.example/1", None, ["x", "", None]), (2, " Clerk ", None, "", "Vollzeit", None, "https://a.example", None, None, None)], FIELDS
    )
    shown = export.export_rows(rows, "detail_id", F.col("detail_id"))
    assert {r["workbook"]: r["n"] for r in export.split_counts(shown).collect()} == {"all": 2, "internship": 1, "working_student": 0, "thesis": 0, "hiwi": 0, "regular_or_other": 1}
    paths = export.write_splits(shown, "detail_id", str(tmp_path), "My Run")
    assert len(paths) == len(export.SPLITS)
    with zipfile.ZipFile(paths[0]) as book:
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.index("Clerk") < sheet.index("Praktikum A") and 'ref="A1:L3"' in sheet


def test_queue_of_a_configuration(spark, tmp_path):
    config = {
        "query_generation": {"query_groups": {"g": ["One", "Two", "one"]}, "active_locations": ["A Stadt", "B"]},
        "sources": {
            "indeed": {"enabled": True, "url_template": "https://i.example/?q={query_plus}&l={location_plus}", "max_pages_per_search": 2},
            "off": {"url_template": "https://o.example"},
            "xing": {"enabled": True, "url_template": "https://x.example/{query_slug}", "supported_locations": ["B"]},
        },
        "run_safety": {"max_urls_per_source": 5, "max_total_urls": 6},
    }
    got = [(r["place"], r["source"], r["url"]) for r in queue.planned_queue(spark, config, plan=queue.Plan("g")).orderBy("place").collect()]
    assert [p for p, _, _ in got] == list(range(1, 7))
    assert [s for _, s, _ in got] == ["indeed", "xing", "indeed", "indeed", "indeed", "indeed"]
    assert got[0][2] == "https://i.example/?q=One&l=A+Stadt"
