"""Edge cases and brute-force comparisons of the training-data operators."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelake.llm import boilerplate, canonical, charform, langid, leakage, linkage, packing, repetition, residue
from hirelake.llm.components import components
from hirelake.llm.neardup import NearDuplicates

WORDS = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ato", "eri", "ulo", "ima", "osse", "ent", "arb", "usk")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- 4: character form


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ｍｏｂｉｌ", "Mobil"),
        ("ﬂows", "flows"),
        ("ärger", "ärger"),
        ("so​fort﻿", "sofort"),
        ("a b　c", "a b c"),
        ("Тeam", "Team"),
        ("Реdаl", "Pedal"),
        ("maɡic", "magic"),
        ("Русский Ελληνικά", "Русский Ελληνικά"),
        ("m² „so“ … – • → CO₂ ½", "m² „so“ … – • → CO₂ ½"),
        ("𝗕𝗼𝗹𝗱 text", "Bold text"),
        ("", ""),
        ("plain\nlines", "plain\nlines"),
    ],
)
def test_form(text, want):
    assert charform.form(text) == want
    assert charform.form(want) == want


def test_form_of_tables(spark):
    rows = spark.createDataFrame(
        [(1, "a b", None, "x"), (1, "a b", None, "x"), (2, "", "Straße", "y"), (3, "Ｘ" * 200_000, "ok", "z")],
        "id bigint, title string, body string, form string",
    )
    found = charform.changed_fields(rows, "id", ["title", "body"]).collect()
    assert sorted((r["id"], r["field_name"]) for r in found) == [(1, "title"), (1, "title"), (3, "title")]
    keyed = charform.normalise(rows, ["body"]).where("id = 2").first()
    assert keyed["body_key"] == "strasse" and keyed["body_changed"] is False
    assert charform.changed_fields(rows.where("false"), "id", ["title"]).count() == 0


# --- 10: repetition


def brute_share(text, n=8):
    words = re.findall(r"[^\W_]+", text.lower())
    seen, marked = set(), [False] * len(words)
    for i in range(len(words) - n + 1):
        key = tuple(words[i : i + n])
        if key in seen:
            marked[i : i + n] = [True] * n
        seen.add(key)
    return sum(marked) / len(words) if words else 0.0


def test_repetition_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "one", "a " * 50_000]
    for _ in range(60):
        parts = [sentence(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12))))
    rows = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    got = {r["doc_id"]: r for r in repetition.ledger(rows).collect()}
    for n, text in enumerate(texts):
        assert got[n]["sequence_share"] == pytest.approx(brute_share(text or ""))
    assert got[0]["failed_bits"] == 0 and got[4]["failed_bits"] & repetition.rule_bit("repeated_sequence_words")
    assert repetition.ledger(rows.where("false")).count() == 0
    ledger = repetition.ledger(rows)
    removed = repetition.apply_policy(ledger, "v2").count()
    assert {r["removed"] for r in repetition.ablations(ledger).where("policy = 'v2'").collect()} == {removed}


# --- 9: leakage


def longest_run(doc, item):
    best = 0
    row = [0] * (len(item) + 1)
    for w in doc:
        row = [0] + [row[j] + 1 if w == item[j] else 0 for j in range(len(item))]
        best = max(best, *row)
    return best


def test_leakage_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(n, sentence(rng, 50)) for n in range(6)] + [(6, "short item"), (7, None)]
    docs = [(0, None), (1, ""), (2, items[0][1].upper().replace(" ", " -- "))]
    for n in range(3, 40):
        text = sentence(rng, rng.randint(0, 60))
        if rng.random() < 0.6:
            words = items[rng.randrange(6)][1].split()
            at = rng.randint(0, 30)
            text += " unk " + " ".join(words[at : at + rng.choice((9, 12, 13, 14, 20))]) + " " + sentence(rng, 5)
        docs.append((n, text))
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    passages = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for d, text in docs:
        for i, passage in items:
            run = longest_run(re.findall(r"\w+", (text or "").lower()), (passage or "").split())
            if run >= 13:
                want[d, i] = run
    for shard, block in ((2_000_000, 2_000_000), (100, 60)):
        got = leakage.matches(documents, passages, shard_words=shard, most_item_words=block)
        assert {(r["doc_id"], r["item_id"]): r["words"] for r in got.collect()} == want
    assert leakage.without_leaks(documents, got).count() == len(docs) - len({d for d, _ in want})
    assert leakage.matches(documents, passages.where("false")).count() == 0


def test_a_task_holds_one_suffix_shard_at_a_time(spark):
    rng = random.Random(4)
    docs = [(n, sentence(rng, 150_000)) for n in range(4)]
    passages = spark.createDataFrame([(n, " ".join(text.split()[-20:])) for n, text in docs], "item_id string, text string")
    shards = leakage.SuffixShards(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), shard_words=200_000)
    files = [pq.ParquetFile(path.removeprefix("file:")).metadata for path in shards.shards.inputFiles()]
    assert [f.row_group(n).num_rows for f in files for n in range(f.num_row_groups)] == [1, 1, 1, 1]
    got = {(r["doc_id"], r["item_id"], r["words"], r["doc_word"], r["item_word"]) for r in shards.matches(passages, most_item_words=50).collect()}
    assert got == {(n, str(n), 20, 149_980, 0) for n in range(4)}


# --- 8: packing


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    docs = [(n, sentence(rng, rng.choice((3, 40, 150, 300)))) for n in range(400)] + [(400, None), (401, ""), (402, sentence(rng, 9000)), (402, "again")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    containers = spark.createDataFrame([("s", 256), ("l", 2048), ("m", 1024), ("none", None)], "container_kind string, capacity_tokens int")
    got = packing.packing(documents, containers, shard_tokens=100_000).toPandas()
    encode = packing.encoder(packing.VOCABULARY).encode_ordinary
    sizes = pd.Series({n: len(encode(t)) if t else 0 for n, t in docs[:402]})
    placed = got[got.n_tokens > 0]
    assert (got[got.doc_id < 402].groupby("doc_id").n_tokens.sum() == sizes).all()
    capacity = placed.container_kind.map({"s": 256, "m": 1024, "l": 2048})
    used = placed.groupby("container_id").n_tokens.sum()
    assert (used <= capacity.groupby(placed.container_id).first()).all()
    assert used.sum() / capacity.groupby(placed.container_id).first().sum() > 0.97
    big = placed[(placed.doc_id == 402) & (placed.piece_no >= 0)].sort_values("piece_no")
    assert (big[big.piece_no > 0].token_start % 2048 == 0).all()
    assert got[got.n_tokens == 0].container_id.isna().all() and (got.n_tokens == 0).sum() == 2
    assert packing.packing(documents, containers.where("false")).where("container_id is not null").count() == 0


# --- 5: near-duplicates


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for group in range(25):
        base = sentence(rng, 80).split()
        for copy in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(copy * 2):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), "t", None, " ".join(words), "extra"))
    rows += [(900, None, None, None, ""), (901, "t", "c", "too short", ""), (902, *rows[0][1:]), (903, *rows[0][1:])]
    df = spark.createDataFrame(rows, "id bigint, title string, company string, body string, signature string")
    sets = {r[0]: set(zip(*[(" ".join(("t", r[3] or ""))).split()[i:] for i in range(3)])) for r in rows if r[3] and len(r[3].split()) >= 40}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    found = NearDuplicates(df, "id", ["title", "company", "body"])
    got = {(r["id_a"], r["id_b"]) for r in found.pairs().collect()}
    assert {p for p, s in share.items() if s >= 0.6} <= got
    assert all(share[p] >= 0.5 for p in got)
    groups = {r["id"]: r for r in found.groups().collect()}
    assert set(groups) == set(sets) and groups[902]["class_id"] == 0 and groups[903]["group_id"] == groups[0]["group_id"]
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in got)
    assert NearDuplicates(df.where("false"), "id", ["title", "company", "body"]).pairs().count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 180)] + [(5, 5), (7, 6), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert set(got.values()) == {0, 100} and len(got) == 61 + 80
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# --- 2: residue


@pytest.mark.parametrize(
    "title, kind",
    [
        ("{{job_title}}", "placeholder"), ("Editor %LOCATION%", "placeholder"), ("undefined (m/w/d)", "missing"), ("Lorem ipsum 3", "filler"),
        ("– Page missing", "notice"), ("404", "notice"), ("Tester (404-Team)", None), ("Developer {JavaScript}", None), ("Tester [unbefristet]", None),
        ("Maintenance Engineer", None), ("", None), (None, None), ("  ", None),
    ],
)
def test_title_residue(spark, title, kind):
    rows = spark.createDataFrame([(1, title, None, "board")], "id bigint, title string, body string, source string")
    got = residue.residue(rows, "id", "title", "body", "source").collect()
    assert [r["kinds"] for r in got] == ([[kind]] if kind else [])


def test_description_residue(spark):
    rng = random.Random(5)
    long = sentence(rng, 60)
    cases = {
        1: (f"{long}\nAs part of %%team%% you maintain imports", True),
        2: (f"{long}\nYou write templates in which {{{{ user.name }}}} or ${{total}} is filled in at run time", False),
        3: (f"{long}\nYou keep null checks, NaN handling and undefined fields out of feeds", False),
        4: (f"{long}\nlorem ipsum dolor amet velit nulla nisi", True),
        5: ("Access denied. Your request was blocked (ref 77).", True),
        6: (f"{long}\nPlease switch on JavaScript to use the map", False),
        7: (f"{long}\nThe contact is undefined", True),
        8: (None, False),
        9: ("", False),
        10: (long * 3000, False),
        11: (f"{long}\nSalary (NaN) per month", True),
        12: (f"{long}\nThe value:nil/none", True),
        13: (f"{long}\nbla, bla, bla, bla", True),
        14: (f"{long}\nYour contact is nil,ask later", True),
        15: ("---\n***", False),
        16: (f"{long}\nYou will join __team_name__ and report to the field service team", True),
        17: ("Placeholder copy, replace before launch", True),
        18: (f"{long}\nYou will join $var_city and report to {{0}}", False),
        19: (f"{long}\nThe job in <Abteilung> starts soon", True),
    }
    rows = spark.createDataFrame([(k, "Tester", t, "board") for k, (t, _) in cases.items()], "id bigint, title string, body string, source string")
    found = residue.residue(rows, "id", "title", "body", "source")
    assert {r["id"] for r in found.collect()} == {k for k, (_, bad) in cases.items() if bad}
    assert residue.without_residue(rows, found, "id").count() == len([1 for _, bad in cases.values() if not bad])
    assert residue.residue(rows.where("false"), "id", "title", "body", "source").count() == 0


@pytest.mark.parametrize("kind, signs, pattern", residue._RULES)
def test_signs_are_implied_by_their_rules(kind, signs, pattern):
    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def run(text):
        assert any(sign in text for sign in signs)

    run()


def test_residue_by_recurrence_and_by_message(spark):
    unknown = "Diese Kiste ist leider leer\nKomm doch morgen wieder"
    rows = [(n, None, unknown, f"board{n % 4}") for n in range(8)]
    rows += [(100 + n, None, f"Komm doch morgen wieder\nEigene Zeile {'abcdefgh'[n]}", f"board{n % 4}") for n in range(8)]
    rows += [(200 + n, None, "Nur auf einer Seite", "board0") for n in range(8)]
    rows += [(300, None, unknown, None), (300, None, unknown, None)]
    table = spark.createDataFrame(rows, "id bigint, title string, body string, source string")
    found = {r["id"]: r["kinds"] for r in residue.residue(table, "id", "title", "body", "source").collect()}
    assert found == {n: ["recurring"] for n in (*range(8), 300)}


def test_residue_is_what_its_rules_say_of_every_line(spark):
    rules, rng = residue.Rules(), random.Random(8)
    odd = ["{{x}}", "nan", "NaN,", "(nil)", "bla bla", "lorem ipsum", "[Firma einfügen]", "%%a%%", "__b_c__", "#team#", "todo: x", "xxxx", "#N/A"]
    texts = ["\n".join(" ".join([sentence(rng, 12), rng.choice(odd), sentence(rng, 8)]) for _ in range(4)) for _ in range(150)]
    table = spark.createDataFrame([(n, None, t, "board") for n, t in enumerate(texts)], "id bigint, title string, body string, source string")
    found = {r["id"]: set(r["kinds"]) for r in residue.residue(table, "id", "title", "body", "source").collect()}
    for n, text in enumerate(texts):
        want = set().union(*(rules.classify(residue.mask(charform.form(line))) for line in text.split("\n"))) - {"notice"}
        assert found.get(n, set()) == want


# --- 1: boilerplate


def test_site_templates(spark):
    rng = random.Random(6)
    furniture, rows, truth = ["Follow us", "Privacy · Terms · Board", "We use cookies to count visits"], [], {}
    for n in range(400):
        body = ["What you do", *(f"- {sentence(rng, 9)} {n}" for _ in range(4)), "", sentence(rng, 20)]
        lines = [*body, "", *rng.sample(furniture, 2)]
        truth[n] = {len(body) + 1, len(body) + 2}
        rows.append((n, f"https://www.board{n % 2}.example/{n}", f"Tester {n}", f"Firm{chr(97 + n % 9)} GmbH", "Ort", "\n".join(lines), "x"))
    copy = rows[0][5]
    rows += [(1000 + n, "https://www.board0.example/c", "Tester", "Firma GmbH", "Ort", copy, "x") for n in range(200)]
    rows += [(5000, None, None, None, None, None, None), (5001, "https://www.board1.example/e", None, None, None, "", None)]
    df = spark.createDataFrame(rows, "id bigint, url string, title string, company string, place string, body string, main string")
    found = boilerplate.SiteTemplates(df, "id", "url", "body", "company", ["title", "company", "place"], keep_text=True)
    got = {r["id"]: set(r["furniture_lines"]) for r in found.marked().collect()}
    divided = boilerplate.SiteTemplates(df, "id", "url", "body", "company", ["title", "company", "place"], task_pages=7)
    assert {r["id"]: set(r["furniture_lines"]) for r in divided.marked().collect()} == got
    assert {n: got[n] for n in truth} == truth
    assert got[1000] == truth[0] and got[5000] == set() and got[5001] == set()
    texts = {r["id"]: r["main"] for r in found.main_texts().collect()}
    assert texts[5000] is None and texts[5001] == "" and "Follow us" not in texts[1] and "What you do" in texts[1]
    empty = boilerplate.SiteTemplates(df.where("false"), "id", "url", "body", "company", ["title"])
    assert empty.marked().count() == 0


@pytest.mark.parametrize("company", ["Firma GmbH", None])
def test_templates_of_hosts_with_one_employer_or_none(spark, company):
    rng = random.Random(8)
    furniture, rows, truth = ["Follow us", "Privacy · Terms · Board", "We use cookies to count visits"], [], {}
    for n in range(120):
        body = ["What you do", *(f"- {sentence(rng, 9)} {n}" for _ in range(4)), "", sentence(rng, 20)]
        truth[n] = {len(body) + 1, len(body) + 2}
        rows.append((n, f"https://www.board.example/{n}", f"Tester {n}", company, "\n".join([*body, "", *rng.sample(furniture, 2)])))
    copy = "\n".join(sentence(rng, 12) for _ in range(4))
    rows += [(1000 + n, "https://www.board.example/c", "Copied", company, copy) for n in range(60)]
    df = spark.createDataFrame(rows, "id bigint, url string, title string, company string, body string")
    got = {r["id"]: set(r["furniture_lines"]) for r in boilerplate.SiteTemplates(df, "id", "url", "body", "company", ["title", "company"]).marked().collect()}
    assert {n: got[n] for n in truth} == truth and got[1000] == set()


def test_templates_of_thousands_of_small_hosts(spark):
    rng, rows, truth = random.Random(4), [], {}
    for host in range(2000):
        menu = f"Jobs of {sentence(rng, 2)}"
        for n in range(8):
            body = ["What you do", *(f"- {sentence(rng, 9)} {host}" for _ in range(3)), "", sentence(rng, 20)]
            truth[host * 10 + n] = {len(body) + 1}
            rows.append((host * 10 + n, f"https://host{host}.example/{n}", f"Tester {n}", f"Firm{'abcdefgh'[n]} AG", "\n".join([*body, "", menu])))
    df = spark.createDataFrame(rows, "id bigint, url string, title string, company string, body string").repartition(8)
    got = {r["id"]: set(r["furniture_lines"]) for r in boilerplate.SiteTemplates(df, "id", "url", "body", "company", ["title"]).marked().collect()}
    assert got == truth


def test_repeated_keys_keep_their_own_lines(spark):
    rng, rows = random.Random(3), []
    for n in range(60):
        body = ["What you do", *(f"- {sentence(rng, 9)}" for _ in range(3)), sentence(rng, 20)]
        rows.append((n // 2, "https://a.example/x", f"Tester {n}", f"Firm{'abcdefgh'[n % 8]} AG", "\n".join([*body, "", "Follow us"])))
    df = spark.createDataFrame(rows, "id bigint, url string, title string, company string, body string")
    texts = boilerplate.SiteTemplates(df, "id", "url", "body", "company", ["title"], keep_text=True).main_texts().collect()
    assert len(texts) == 60 and not [r for r in texts if "Follow us" in r["main"]]


def test_blocks_are_deleted_whole(spark):
    rng, rows = random.Random(2), []
    for n in range(80):
        words = sentence(rng, 15)
        rows.append((n, "https://a.example/x", f"Tester {n}", f"Firm{'abcdefgh'[n % 8]} AG", f"{words}\n\nOur app\nfor your phone\n\n{sentence(rng, 12)}"))
    df = spark.createDataFrame(rows, "id bigint, url string, title string, company string, body string")
    got = boilerplate.SiteTemplates(df, "id", "url", "body", "company", ["title"]).marked().collect()
    assert {tuple(r["furniture_lines"]) for r in got} == {(2, 3)}


# --- 3: languages


SAMPLES = {
    "german": "Du hilfst der Leitstelle bei allem was die Tourenplaner betrifft und schreibst das Gelernte auf damit niemand lange suchen muss.",
    "english": "You help the operations desk with everything about route planners and write down what you learn so that nobody has to search.",
    "french": "Vous aidez le service avec tout ce qui concerne les tournées et vous notez ce que vous apprenez pour que personne ne cherche.",
    "dutch": "Je helpt de meldkamer met alles wat de routeplanners aangaat en schrijft op wat je leert zodat niemand lang hoeft te zoeken.",
    "polish": "Pomagasz dyspozytorni we wszystkim co dotyczy planowania tras i zapisujesz czego się uczysz żeby nikt nie musiał długo szukać.",
    "spanish": "Ayudas a la central con todo lo que toca a las rutas y anotas lo que aprendes para que nadie tenga que buscar mucho tiempo.",
}


def test_languages(spark):
    rng = random.Random(7)
    texts, labels, want = [], [], {}
    n = 0
    for language, text in SAMPLES.items():
        for k in range(20):
            words = text.rstrip(".").split()
            long = "\n\n".join(" ".join(rng.sample(words, len(words))) + "." for _ in range(3))
            label = language if k < 15 else {15: None, 16: "n/a", 17: "mixed", 18: language[:2].upper() if language in ("english", "french") else language, 19: "wrong"}[k]
            texts.append((n, long + "\n\n" + SAMPLES["english" if language != "english" else "german"] if k == 0 else long))
            labels.append((n, label))
            if k == 0:
                want[n, 4] = "english" if language != "english" else "german"
            if k in (15, 16, 17, 19):
                want[n, 0] = language
            n += 1
    texts += [(900, None), (901, " "), (902, "too short")]
    a = spark.createDataFrame(texts, "id bigint, body string")
    b = spark.createDataFrame(labels, "id bigint, label string")
    found = langid.segments(a, b, "id", "body", "label")
    got = {(r["id"], r["segment_no"]): r["language"] for r in langid.corrections(found, b, "id", "label").collect()}
    assert got == want
    assert found.where("confidence < 0 or confidence > 1.000001").count() == 0
    assert langid.segments(a.where("false"), b, "id", "body", "label").count() == 0


def test_language_labels(spark):
    rows = spark.createDataFrame([("de-DE",), ("Français",), ("en_GB",), ("POLISH",), ("und",), ("",), (None,)], "label string")
    assert [r[0] for r in rows.select(langid.label_of(F.col("label"))).collect()] == ["german", "french", "english", "polish", None, None, None]


# --- 6: canonical values


def test_canonical_values(spark):
    listed = [
        (1, "place", "Zöllbrück", "Auental", "Zöllogate"), (2, "place", "Hüllstadt an der Ilse", "Mittelhag", None),
        (3, "place", "Hüllstadt (Ostrilde)", "Ostrilde", None), (4, "place", "Tarnheim", "Nordwiek", None),
        (10, "kind", "Full-time", None, None), (11, "kind", "Part-time", None, None), (12, "kind", "Internship", None, None),
    ]
    cases = {
        "Zoellbrueck": 1, "12345 ZÖLLBRÜCK": 1, "Zölbrück, Auental": 1, "Zlölbrück": 1, "zöllogate": 1, "Raum Zöllbrück (hybrid)": 1, "Hüllstadt/Ilse": 2,
        "Hüllstadt in Ostrilde": 3, "Hüllstadt": -1, "Zöllbrück / Tarnheim": -1, "Anywhere": -1, "-": -1, "D-Tarnheim": 4, "Tarnhiem": 4, "Tarnhxyz": -1,
    }
    kinds = {"VZ": 10, "Vollziet": 10, "Teilzeit (20 Std.)": 11, "Praktikum, 6 Monate": 12, "m/w/d": -1, "30 Tage Urlaub": -1, "Full-time ": 10}
    rows = [(n, v, None, "x") for n, v in enumerate(cases)] + [(100 + n, None, v, "x") for n, v in enumerate(kinds)]
    rows += [(900, "Tarnheim", "Full-time", "x"), (901, " ", "", "x"), (902, None, None, "x"), (0, "Zoellbrueck", None, "x")]
    df = spark.createDataFrame(rows, "id bigint, place string, kind string, value string")
    refs = spark.createDataFrame(listed, "ref_id int, field_name string, canonical_value string, place_region string, other_name string")
    got = canonical.mapping(df, refs, "id", ["place", "kind"], ["place"])
    assert {r["value"]: r["ref_id"] for r in got.collect()} == cases | kinds
    assert got.where("id = 0").count() == 2
    assert {r["ref_id"] for r in canonical.mapping(df, refs.where("false"), "id", ["place", "kind"], ["place"]).collect()} == {-1}
    assert canonical.mapping(df.where("false"), refs, "id", ["place", "kind"], ["place"]).count() == 0


# --- 7: linkage


def test_linkage(spark):
    columns = "title string, company string, location_raw string, source_job_url string"
    filler = [(1000 + n, f"https://b.example/{n}", None, f"Clerk {s} {t}", f"Firm{chr(97 + n % 20)}zz GmbH", "Tarnheim", None) for n, (s, t) in enumerate([("Retail", "Security"), ("Fleet", "Backend"), ("Retail", "Backend"), ("Fleet", "Security")] * 10)]
    left = [
        (1, "https://b.example/a", None, "Senior Editor Retail Security (m/w/d)", "Zelvadan Druck SE", "Zöllbrück", "https://b.example/a"),
        (2, "https://b.example/b", None, "RETAIL SECURITY – Seniοr Redakteur", "Zelvdan Druck", "12345 Zöllbrück", None),
        (3, "https://b.example/c", None, "Editor Retail Security", "Zelvadan Druck SE", "Zöllbrück", None),
        (4, "https://b.example/d", None, "Senior Editor Retail Backend", "Zelvadan Druck SE", "Zöllbrück", None),
        (5, "https://b.example/e", None, "Senior Editor Retail Security", "Otherfirm AG", "Zöllbrück", None),
        (6, "https://b.example/f", None, "Senior Editor Retail Security", "Zelvadan Druck SE", "Tarnheim", None),
        (7, "https://b.example/g", "https://x.zelvadan.example/1", "Senior Editor Retail Security", None, "Zöllbrück", None),
        (8, "https://b.example/h", None, None, "Zelvadan Druck SE", None, "https://b.example/jobs/zoellbrueck-senior-editor-retail-security-300"),
        (9, "https://b.example/i", None, None, None, None, None),
        *filler,
    ]
    right = [
        (1, "Leading Clerk Fleet Backend", "Zelvadan Druck SE", "Zöllbrück", None),
        (2, "Senior Redakteur Retail Security", "ZELVADAN Druck", "Zöllbrück, Auental", "https://www.zelvadan.example/1"),
        (3, None, None, None, None),
    ]
    places = [(1, "Zöllbrück", "Auental", None), (2, "Tarnheim", "Nordwiek", None)]
    a = spark.createDataFrame(left, f"detail_id bigint, url string, apply_url string, {columns}")
    b = spark.createDataFrame(right, f"feed_id bigint, {columns}")
    p = spark.createDataFrame(places, "ref_id int, canonical_value string, place_region string, other_name string")
    link = lambda x, y: linkage.Linkage(x, "detail_id", "url", "apply_url", y, "feed_id", p).matches()
    got = link(a, b).collect()
    assert sorted((r["detail_id"], r["feed_id"]) for r in got) == [(1, 2), (2, 2), (7, 2), (8, 2)]
    assert all(0.6 <= r["confidence"] <= 1 for r in got)
    assert link(a.where("false"), b).count() == 0 and link(a, b.where("false")).count() == 0


def linked(spark, left, right):
    columns = "title string, company string, location_raw string, source_job_url string"
    a = spark.createDataFrame([(n, f"https://b.example/{n}", None, *row) for n, row in enumerate(left)], f"detail_id bigint, url string, apply_url string, {columns}")
    b = spark.createDataFrame([(n, *row) for n, row in enumerate(right)], f"feed_id bigint, {columns}")
    p = spark.createDataFrame([(1, "Zöllbrück", "Auental", None), (2, "Tarnheim", "Nordwiek", None)], "ref_id int, canonical_value string, place_region string, other_name string")
    got = linkage.Linkage(a, "detail_id", "url", "apply_url", b, "feed_id", p).matches().collect()
    return sorted((r["detail_id"], r["feed_id"]) for r in got)


def test_misspelt_employers_meet_where_another_attribute_is_missing(spark):
    left = [
        ("Editor Retail Security", "Zelvdan Druck SE", None, None),
        ("Retail Security", "Zlevadan Druck SE", "Zöllbrück", None),
        ("Editor", "Zelvadann Druck SE", "Zöllbrück", None),
        ("Editor Retail Security", "Zelvdan Robotik SE", None, None),
        ("Editor Retail Security", "Otherfirm AG", None, None),
        ("Editor Retail Security", "Zelvudin Druck SE", None, None),
        *[(f"Clerk {s}", "Firmazz GmbH", "Tarnheim", None) for s in ("Retail Security", "Fleet Backend")],
    ]
    right = [("Editor Retail Security", "Zelvadan Druck SE", "Zöllbrück", None), ("Clerk Fleet Backend", "Zelvadan Druck SE", "Zöllbrück", None)]
    assert linked(spark, left, right) == [(0, 0), (1, 0), (2, 0)]


def test_rare_subjects_count_whole(spark):
    filler = [(f"Clerk {a} {b}", "Firmazz GmbH", "Tarnheim", None) for a in WORDS for b in WORDS[:3]]
    job = lambda title, place="Zöllbrück": (f"Editor {title}", "Zelvadan Druck SE", place, None)
    left = [
        job("Glaciology"), job("Heraldry"), job("Glaciology", None), job("Retail Security Museum Cartography"), job("Retail Security Museum Falconry"),
        job("Limnology Kryptology {{ start.date }}"), job("Limnology Kryptology [unbefristet]"), job("Limnologgy Kryptology"), job("Limnology"),
        job("Limnology Kryptology"), *filler,
    ]
    right = [job("Glaciology"), job("Retail Security Museum Cartography"), *[job("Limnology Kryptology")] * 2, job("Limnology Kryptology {Braille}")]
    # 6 and the last listing each add another word
    assert linked(spark, left, right) == [(0, 0), (2, 0), (3, 1), *[(n, k) for n in (5, 6, 7, 9) for k in (2, 3, 4) if (n, k) != (6, 4)]]


def test_near_names_equal_brute_force(spark):
    rng = random.Random(9)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    for word in ("zelvadandruck", "tracrolith", "müllerei"):
        for _ in range(40):
            letters = list(word)
            for _ in range(rng.randint(1, 3)):
                n = rng.randrange(len(letters))
                letters[n : n + 1] = rng.choice(([], ["x"], [letters[n], "y"]))
            names.add("".join(letters))
    df = spark.createDataFrame([(n,) for n in sorted(names)], "who string")
    want = {(a, b) for a in names for b in names if linkage.one_edit(a, b)}
    found = linkage.near_names(df, df).collect()
    got = {(r[0], r[1]) for r in found if r["close"]}
    assert all(set(a) & set(b) for a, b in got) and all(not set(a) & set(b) for a, b in want - got)
    assert not {p for p in got - want if sorted(p[0]) != sorted(p[1])}
    starts = [n for n in sorted(names) if len(n) > 8]
    alike = {(a, b) for a in starts for b in starts if a[8:] == b[8:] and sum(x != y for x, y in zip(a, b)) == 2 and len(a) == len(b)}
    assert alike <= {(r[0], r[1]) for r in found}


def test_alternating_directions_find_the_optimum():
    similar, weight = np.array([[1.0, 1.0], [1.0, 0.0], [1.0, 1.0], [1.0, 1.0]]), np.full((4, 2, 2), 1.0)
    weight[..., 1] = 4
    alone = linkage.solve(similar, weight, np.arange(4), np.arange(4), np.arange(4))
    assert alone[0] > 0.95 and alone[1] < 0.1
    rival = linkage.solve(similar[2:], weight[2:], np.zeros(2, int), np.arange(2), np.arange(2))
    assert rival.sum() < 1.1
    twice = linkage.solve(similar[2:], weight[2:], np.zeros(2, int), np.zeros(2, int), np.arange(2))
    assert twice.min() > 0.95


def test_ties_across_pages_change_confidences(spark):
    nan = float("nan")
    schema = "page bigint, a bigint, f bigint, job bigint, said bigint, employer double, role double, subject double, place double"
    sure, weak = (1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 0.6, nan)
    alone = [(1, 1, 1, 1, 0, *weak)]
    tied = [(1, 1, 1, 1, 0, *weak), *((n, n, 1, 1, 0, *sure) for n in range(2, 6))]
    rival = [(1, 1, 1, 1, 7, *weak), *((n, n, 1, 1, 0, *sure) for n in range(2, 6))]
    value = lambda rows: {r["a"]: r["value"] for r in linkage.confidences(spark.createDataFrame(rows, schema)).collect()}[1]
    assert value(rival) < value(alone) < value(tied)
    assert linkage.confidences(spark.createDataFrame([], schema)).count() == 0


def test_null_pages_are_apart(spark):
    columns = "id bigint, url string, apply_url string, title string, company string, location_raw string, source_job_url string"
    title = "Senior Developer Bakery Robotics"
    posts = [(n, None, None, title, "Lumdrajet GmbH", town, None) for n, town in enumerate(["Bremen", "Ulm", "Bremen", None])]
    feed = [(n, title, "Lumdrajet", town, None) for n, town in enumerate(["Bremen", "Ulm"])]
    places = [(1, "Bremen", "X", None), (2, "Ulm", "Y", None)]
    found = linkage.Linkage(
        spark.createDataFrame(posts, columns), "id", "url", "apply_url",
        spark.createDataFrame(feed, "feed bigint, title string, company string, location_raw string, source_job_url string"), "feed",
        spark.createDataFrame(places, "ref_id int, canonical_value string, place_region string, other_name string"),
    ).matches()
    assert {(r["id"], r["feed"]) for r in found.collect()} == {(0, 0), (2, 0), (1, 1)}


def test_keys_are_full_case_folding(spark):
    texts = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([("".join(texts[n : n + 1]),) for n in range(len(texts))], "t string").repartition(4)
    got = rows.select("t", charform.key_of(F.col("t")).alias("k")).collect()
    assert [r["t"] for r in got if r["k"] != r["t"].casefold()] == []


def test_languages_without_labels_or_letters(spark):
    texts = spark.createDataFrame([(1, "Wir suchen dich für unser Team in Bremen. " * 8), (2, "12 34 56\n\n--- 78")], "id bigint, text string")
    unknown = spark.createDataFrame([(1, "unknown"), (2, None)], "id bigint, label string")
    assert langid.segments(texts, unknown, "id", "text", "label").count() == 0
    known = spark.createDataFrame([(1, "German"), (2, "de")], "id bigint, label string")
    got = langid.segments(texts, known, "id", "text", "label").collect()
    assert {(r["id"], r["segment_no"], r["language"]) for r in got} == {(1, 0, "german"), (1, 1, "german")}
    assert all(r["confidence"] > 0.99 for r in got)


@pytest.mark.parametrize("size, letters", [(0, 1), (1, 1), (5, 1), (200, 1), (300, 2), (400, 3), (500, 40)])
def test_suffix_arrays_are_in_complete_order(size, letters):
    rng = np.random.default_rng(size)
    text = rng.integers(1, letters + 1, size=size).astype(np.int32)
    text = np.concatenate((text, [0], text, [0])).astype(np.int32)
    order = leakage.suffix_array(text)
    suffixes = [tuple(text[n:]) for n in order]
    assert sorted(order) == list(range(len(text))) and suffixes == sorted(suffixes)


def test_all_locations_equal_brute_force():
    rng = np.random.default_rng(3)
    text = np.concatenate([x for _ in range(6) for x in (rng.integers(1, 4, size=60), [0])])
    query = np.concatenate((text[5:40], [0], rng.integers(1, 4, size=30), [-1], text[70:100]))
    t, q, length = leakage.find(text, leakage.suffix_array(text), query, 6)
    want = set()
    for i in range(len(text)):
        for j in range(len(query)):
            if i and j and text[i - 1] == query[j - 1] > 0:
                continue
            n = 0
            while i + n < len(text) and j + n < len(query) and text[i + n] == query[j + n] > 0:
                n += 1
            if n >= 6:
                want.add((i, j, n))
    assert set(zip(t.tolist(), q.tolist(), length.tolist())) == want and len(t) == len(want) > 3
