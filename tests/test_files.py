import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.sinks import files as sinks
from hirelake.sources import files as sources
from hirelake.sources.html import parse_pages
from hirelake.streaming.pool import Pool

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType())])


def test_jsonl_skips_bad_lines_and_keeps_mistyped_rows(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": "x", "n": 1}\n\n{bad\n{"a": "y", "n": "z"}\n', encoding="utf-8")
    rows = sorted((r["a"], r["n"]) for r in sources.read_jsonl(spark, str(path), SCHEMA).collect())
    assert [r[0] for r in rows] == ["x", "y"] and rows[0][1] == 1 and rows[1][1] is None
    assert sources.malformed_lines(spark, str(path)).count() == 1


def test_json_document_keeps_order(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([{"a": "x"}, {"a": "y", "n": 2}]), encoding="utf-8")
    assert [tuple(r) for r in sources.read_json_document(spark, str(path), SCHEMA).orderBy("seq").collect()] == [(0, "x", None), (1, "y", 2)]


def test_latest_file_is_last_by_path(tmp_path):
    for name in ("a.jsonl", "c.ndjson", "b.jsonl", "z.txt"):
        (tmp_path / name).write_text("")
    assert sources.latest_file(str(tmp_path)).endswith("c.ndjson")
    with pytest.raises(FileNotFoundError):
        sources.latest_file(str(tmp_path), "missing")


def test_queue_file_in_both_forms(spark, tmp_path):
    rows = [{"source": "s", "search_query": "q", "url": "u"}, {"source": "", "url": "u"}]
    array, lines = tmp_path / "a.json", tmp_path / "b.jsonl"
    array.write_text(json.dumps(rows))
    lines.write_text("\n".join(map(json.dumps, rows)))
    for path in (array, lines):
        assert [tuple(r) for r in sources.read_queue(spark, str(path)).collect()] == [("s", "q", None, 1, "u")]
    lines.write_text("{bad")
    with pytest.raises(Exception):
        sources.read_queue(spark, str(lines)).collect()


def test_config_must_be_a_mapping(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("- a\n")
    with pytest.raises(ValueError):
        sources.read_config(str(path))


def test_jsonl_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("x", None), ("ä", 2)], SCHEMA)
    sinks.write_jsonl(df, str(tmp_path / "out"), [F.col("a")])
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {"a": "x", "n": None} in got and {"a": "ä", "n": 2} in got


def test_document_and_summary(spark, tmp_path):
    df = spark.range(5)
    assert sinks.write_json_document(df, str(tmp_path / "d.json"), "id") == 5
    with pytest.raises(ValueError):
        sinks.write_json_document(df, str(tmp_path / "d.json"), "id", most=2)
    assert sinks.summary(df, {"n": F.count(F.lit(1))}, "id", 2) == {"n": 5, "sample": [{"id": 0}, {"id": 1}]}
    assert sinks.suffixed("/x/queue.jsonl", "My Group") == "/x/queue_my-group.jsonl"


def test_workbook_is_readable(tmp_path):
    path = tmp_path / "w.xlsx"
    sinks.write_workbook([{"a": "x<&>", "l": "https://e.example/?a=1&b=2"}, {"a": None, "l": None}], ["a", "l"], {"a": 12}, str(path), link="l")
    with zipfile.ZipFile(path) as book:
        import xml.etree.ElementTree as tree

        for name in book.namelist():
            tree.fromstring(book.read(name))
        assert b"x&lt;&amp;&gt;" in book.read("xl/worksheets/sheet1.xml")


def test_pages(spark):
    html = "<html><title>T</title><body><h1>Job <b>A</b></h1><p class='company'>F</p><main>" + "word " * 30 + "</main><script>no</script><a href='/x?apply'>Apply now</a></body></html>"
    rows = spark.createDataFrame([(1, "https://b.example/p/", html), (2, None, None)], "id bigint, url string, html string")
    first, second = parse_pages(rows, "id", "url", "html").orderBy("id").collect()
    assert (first["title"], first["company"], first["apply_url"]) == ("Job A", "F", "https://b.example/x?apply")
    assert first["description"].startswith("word word") and "no" not in first["description"]
    assert second["title"] is None and second["links"] == []


def test_stream_equals_batch_and_repeats_safely(spark, tmp_path):
    data = tmp_path / "in"
    for n, rows in enumerate([[("u1", 1), ("u2", 2), ("u1", 3)], [("u2", 4), ("u3", 5), (None, 6)]]):
        spark.createDataFrame(rows, "url string, seq bigint").coalesce(1).write.mode("append").parquet(str(data))
    pool = Pool(spark, str(tmp_path / "pool"), "url", "seq")
    stream = lambda: spark.readStream.schema("url string, seq bigint").option("maxFilesPerTrigger", 1).parquet(str(data))
    pool.feed(stream(), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["url"] for r in pool.current().collect()) == ["u1", "u2", "u3"]
    pool.feed(stream(), str(tmp_path / "cp2")).awaitTermination()  # a lost checkpoint: every batch again
    assert sorted(r["url"] for r in pool.current().collect()) == ["u1", "u2", "u3"]
    assert pool.statistics().agg(F.sum("found")).first()[0] == 6
