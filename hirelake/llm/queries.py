"""The queries of the ten training-data problems over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import canonical, charform, langid, leakage, packing, repetition, residue
from hirelake.llm.boilerplate import SiteTemplates
from hirelake.llm.linkage import Linkage
from hirelake.llm.neardup import NearDuplicates
from hirelake.runtime import ship, spread, table

FREE_FIELDS = ["location_raw", "employment_type_raw", "workplace_type_raw"]

Query = Callable[[SparkSession, str], DataFrame]


def _templates(spark: SparkSession, sf_dir: str, keep_text: bool = False) -> SiteTemplates:
    pages = table(spark, sf_dir, "parsed_detail").select(
        "detail_id", "url", "title", "company", "location_raw", "description_raw"
    )
    return SiteTemplates(pages, "detail_id", "url", "description_raw", "company", ["title", "company", "location_raw"], keep_text=keep_text)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _templates(spark, sf_dir).marked()
    return marked.select("detail_id", F.explode("furniture_lines").alias("line_no"))


def p1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir, keep_text=True).main_texts().withColumnRenamed("main", "description_main")


def p2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_detail").select("detail_id", "title", "description_raw", "source")
    found = residue.residue(spread(rows), "detail_id", "title", "description_raw", "source")
    return found.select("detail_id", "field_name", F.array_join("kinds", ",").alias("kinds"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_residue(spark, sf_dir).select("detail_id", "field_name")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_detail").select("detail_id", "title", "description_raw")
    return residue.without_residue(rows, p2_found(spark, sf_dir), "detail_id").select("detail_id")


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "parsed_detail").select("detail_id", "description_raw")
    labels = table(spark, sf_dir, "classified").select("detail_id", "posting_language")
    return langid.segments(texts, labels, "detail_id", "description_raw", "posting_language"), labels


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)[0].select("detail_id", "segment_no", "language", "confidence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = langid.corrections(*_languages(spark, sf_dir), "detail_id", "posting_language")
    return wrong.select("detail_id", "segment_no", "language")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_detail").select("detail_id", "title", "description_raw")
    return charform.changed_fields(spread(rows), "detail_id", ["title", "description_raw"]).select(
        "detail_id", "field_name"
    )


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_detail").select("detail_id", "title", "description_raw")
    formed = charform.normalise(spread(rows), ["title", "description_raw"])
    return formed.select("detail_id", "title_form", "title_key", "description_raw_form", "description_raw_changed")


def _near_duplicates(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(
        table(spark, sf_dir, "parsed_detail"), "detail_id", ["title", "company", "description_raw"]
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates(spark, sf_dir).pairs()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates(spark, sf_dir).groups()


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates(spark, sf_dir).groups().select("detail_id", "group_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["title", "company", "location_raw", "source_job_url"]
    postings = table(spark, sf_dir, "parsed_detail").select("detail_id", "url", "apply_url", *columns)
    feed = table(spark, sf_dir, "employer_feed").select("feed_id", *columns)
    places = table(spark, sf_dir, "canonical_values").where(F.col("field_name") == "location_raw")
    return Linkage(postings, "detail_id", "url", "apply_url", feed, "feed_id", places).matches()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("detail_id", "feed_id")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.packing(documents, table(spark, sf_dir, "containers"))


def p6_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.mapping(
        table(spark, sf_dir, "parsed_detail").select("detail_id", *FREE_FIELDS),
        table(spark, sf_dir, "canonical_values"),
        "detail_id",
        FREE_FIELDS,
        ["location_raw"],
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_mapping(spark, sf_dir).select("detail_id", "field_name", "ref_id").distinct()


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leakage.matches(documents, table(spark, sf_dir, "eval_items"))


def p9_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leakage.SuffixShards(documents).matches(table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_matches(spark, sf_dir).select("doc_id", "item_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return leakage.without_leaks(documents, p9_found(spark, sf_dir))


def p10_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.ledger(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.apply_policy(p10_ledger(spark, sf_dir), "v1").select("doc_id").distinct()


def p10_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.ablations(p10_ledger(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_main_text": p1_main_text,
    "p2_found": p2_found,
    "p2_residue": p2_residue,
    "p2_kept": p2_kept,
    "p3_found": p3_found,
    "p3_languages": p3_languages,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_members": p5_members,
    "p6_found": p6_found,
    "p6_mapping": p6_mapping,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p8_packing": p8_packing,
    "p9_found": p9_found,
    "p9_matches": p9_matches,
    "p9_locations": p9_locations,
    "p9_kept": p9_kept,
    "p10_found": p10_found,
    "p10_ledger": p10_ledger,
    "p10_ablations": p10_ablations,
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, query in QUERIES.items()}
