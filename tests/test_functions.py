from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelake.functions import text as t
from hirelake.functions import urls as u
from hirelake.operators import excerpt, ordering, queue, scoring
from hirelake.operators.normalise import header_fields, keywords


def one(spark, value, function, kind="string"):
    rows = spark.createDataFrame([(value,)], f"v {kind}")
    return rows.select(function(F.col("v")).alias("r")).first()["r"]


def test_collapse_knows_all_white_space(spark):
    assert one(spark, "\x1c a\xa0 b 　 c\x85", t.collapse) == "a b c"
    assert one(spark, None, t.collapse) is None


def test_fold_and_slug(spark):
    assert one(spark, "Fließend  Öl", t.normalize) == "fliessend oel"
    assert one(spark, None, t.normalize) == ""
    assert one(spark, " C++ & Öl ", t.slugify) == "cplusplus-and-öl"


def test_first_literal_is_first_in_list(spark):
    assert one(spark, "b then a", lambda c: t.first_literal(c, ("a", "b"))) == "a"
    assert one(spark, "none", lambda c: t.first_literal(c, ("x", "y"))) is None


def test_noise_is_cut_marker_by_marker(spark):
    assert one(spark, "Text\nWeitere Jobs you may like", t.trim_noise) == "Text\nWeitere"
    assert one(spark, "Similar jobs", t.trim_noise) == "Similar jobs"
    assert one(spark, "", t.trim_noise) is None


def test_trim_description(spark):
    assert one(spark, "x Aufgaben Deine Aufgaben y\nSimilar jobs z", t.trim_description) == "Deine Aufgaben y"
    assert one(spark, "Tasks", t.trim_description) == "Tasks"
    assert one(spark, "", t.trim_description) == ""
    assert one(spark, None, t.trim_description) is None


def test_role_kind(spark):
    rows = spark.createDataFrame([("Intern Werkstudent", None), ("internal", "Vollzeit"), ("x", "part"), (None, None)], "a string, b string")
    found = [r["k"] for r in rows.select(t.role_kind(F.col("a"), F.col("b")).alias("k")).collect()]
    assert found == ["internship", "full_time_or_regular", "part_time_regular", "other"]


def test_posting_urls(spark):
    cases = {
        "https://de.indeed.com/viewjob?from=x&jk=abc#y": ("indeed", "https://de.indeed.com/viewjob?jk=abc"),
        "https://de.indeed.com/viewjob?from=x": ("indeed", None),
        "https://WWW.LinkedIn.com/jobs/view/12/?trk=1": ("linkedin", "https://www.linkedin.com/jobs/view/12"),
        "https://www.xing.com/jobs/search?x=1": (None, None),
        "https://www.xing.com/jobs/a-1/": ("xing", "https://www.xing.com/jobs/a-1"),
        "https://www.stellenwerk.de/mainz/job": (None, None),
        "https://www.stellenwerk.de/mainz/job-1": ("stellenwerk", "https://www.stellenwerk.de/mainz/job-1"),
        "nonsense": (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string").withColumn("s", u.source_of(F.col("v")))
    found = {r["v"]: (r["s"], r["p"]) for r in rows.withColumn("p", u.posting_url(F.col("v"), F.col("s"))).collect()}
    assert found == cases


def test_keywords_decode_twice(spark):
    rows = spark.createDataFrame([(["a  b", "a b"], ["https://x/s?q=C%252B%252B&was=zz", "bad", None])], "q array<string>, u array<string>")
    assert rows.select(keywords(F.col("q"), F.col("u")).alias("k")).first()["k"] == ["a b", "C++", "zz"]


def test_header_needs_two_lines_before(spark):
    assert one(spark, "Firma\nTitel\nOrt · 3 days ago\nText", lambda c: F.array(*header_fields(c))) == ["Firma", "Titel", "Ort · 3 days ago"]
    assert one(spark, "Titel\nOrt · 3 days ago", lambda c: F.array(*header_fields(c))) == [None, None, None]


def test_compact_cuts_after_a_line(spark):
    text = "\n".join(f"python {'x' * 90}" for _ in range(60))
    got = one(spark, text, excerpt.compact)
    assert len(got) <= excerpt.MOST_CHARACTERS and text.startswith(got + "\n")
    assert len(one(spark, "python" + "x" * 4000, excerpt.compact)) == excerpt.MOST_CHARACTERS
    assert one(spark, "", excerpt.compact) is None


def test_keep_heading_beats_stop_heading(spark):
    filler = [f"line {n} {'y' * 80}" for n in range(10)]
    text = "\n".join(["Your profile and benefits", *filler, "Benefits", "gone"])
    got = one(spark, text, excerpt.excerpt)
    assert "Your profile" in got and "gone" not in got and "Benefits\n" not in got


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 99)), max_size=30, unique_by=lambda x: x[1]))
def test_interleave_is_a_fair_permutation(spark, rows):
    df = spark.createDataFrame(rows, "k string, n int")
    got = [r["n"] for r in ordering.interleave(df, "k", "n").orderBy("turn", "lane").collect()]
    lanes: dict[str, list[int]] = {}
    for k, n in sorted(rows, key=lambda r: r[1]):
        lanes.setdefault(k, []).append(n)
    want = [lane[i] for i in range(30) for lane in lanes.values() if i < len(lane)]
    assert got == want


def test_numbered_has_no_gaps_past_9999(spark):
    got = ordering.numbered(spark.range(12_000), [F.col("id")], "name", "job_%04d").orderBy("id").collect()
    assert [r["name"] for r in got] == [f"job_{n + 1:04d}" for n in range(12_000)]


def test_unknown_group_is_named(spark):
    config = {"query_generation": {"query_groups": {"a": ["X", "x ", "Y"]}}}
    assert queue.query_texts(config, "a") == ["X", "Y"]
    try:
        queue.query_texts(config, "b")
    except ValueError as error:
        assert "a" in str(error)
    else:
        raise AssertionError


def test_scoring_retries_and_reports(spark):
    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    rows = spark.createDataFrame([("1", "good"), ("2", "bad")], "key string, prompt string")
    got = {r["key"]: (r["answer"], r["error"]) for r in scoring.score(rows, client, sleep=lambda s: None).collect()}
    assert got == {"1": ("GOOD", None), "2": (None, "RuntimeError: no")}
