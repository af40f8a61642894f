from pyspark.sql import functions as F

from hirelake.operators import normalise
from hirelake.streaming.runs import Runs

SIGHTING = "seq bigint, url string, search_url string, title string"


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_runs_reset_and_keep_the_pool(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "state"), 1)
    assert runs.to_parse() is None
    rows = [(1, "u1", "s1", "a"), (2, "u2", "s1", "b"), (3, "u1", "s2", "c"), (4, None, "s3", None)]
    runs.start_queue(stream(spark, str(tmp_path / "a"), rows, SIGHTING)).awaitTermination()
    assert runs.status() | {"running": False} == {"run_id": 1, "running": False, "pool": 2, "run": 2, "details": 0}
    pages = {r["search_url"]: (r["found"], r["added_to_run"], r["error"]) for r in runs.page_statistics(spark.createDataFrame(rows, SIGHTING)).collect()}
    assert pages == {"s1": (2, 2, None), "s2": (1, 0, None), "s3": (0, 0, "no postings found")}
    posting = "detail_id bigint, url string, source_job_url string, title string"
    found = [(1, "u1", "", "x"), (2, "u1", None, "later"), (3, "u2", "u2?x", "y"), (4, None, None, "none")]
    runs.start_details(stream(spark, str(tmp_path / "b"), found, posting)).awaitTermination()
    assert {(r["pool_key"], r["title"]) for r in runs.details.current().collect()} == {("u1", "x"), ("u2?x", "y")}
    runs.start_queue(stream(spark, str(tmp_path / "c"), [(9, "u3", "s1", None), (10, "u1", "s1", None)], SIGHTING)).awaitTermination()
    assert runs.status() | {"running": False} == {"run_id": 1, "running": False, "pool": 3, "run": 2, "details": 0}
    assert {r["url"] for r in runs.to_parse().collect()} == {"u3", "u1"}
    runs.clear()
    assert runs.status()["pool"] == 0


def test_normalised_fallbacks(spark):
    columns = (
        "url string, source_job_url string, source string, sources array<string>, search_queries array<string>, search_urls array<string>, title string, company string, "
        "location_raw string, location string, searchQuery string, description_raw string, workplace_type_raw string, employment_type_raw string, apply_url string"
    )
    rows = [("", "s", "xing", [], ["a"], None, "T", None, "", "Ulm", "b", "Remote, Teilzeit", None, "", None)]
    got = normalise.normalised(spark.createDataFrame(rows, columns)).first()
    assert (got["url"], got["location_raw"], got["search_keywords"], got["sources"]) == ("s", "Ulm", ["a", "b"], ["xing"])
    assert (got["workplace_type_raw"], got["employment_type_raw"]) == ("remote", "part-time")


def test_header_repair_of_one_source(spark):
    body = "Firm X\nDeveloper\nBremen · 3 days ago\nAbout the job\nWe build"
    columns = (
        "url string, source_job_url string, source string, sources array<string>, search_queries array<string>, search_urls array<string>, title string, company string, "
        "location_raw string, description_raw string, workplace_type_raw string, employment_type_raw string, apply_url string"
    )
    rows = [("u", None, s, None, None, None, None, "Given", None, body, None, None, None) for s in ("linkedin", "xing")]
    first, other = normalise.normalised(spark.createDataFrame(rows, columns), "linkedin").collect()
    assert (first["title"], first["company"], first["location_raw"]) == ("Developer", "Given", "Bremen · 3 days ago")
    assert first["description_raw"] == "About the job\nWe build" and (other["title"], other["location_raw"]) == (None, None)
