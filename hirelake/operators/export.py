"""Ranked result tables and their split into workbooks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import text as t
from hirelake.operators.ordering import stable_ranking
from hirelake.sinks.files import column_widths, write_workbook

COLUMNS = [
    "Status", "Score", "Category", "Role Type", "Title", "Company", "Location", "Role Source", "Apply Link", "Reason", "Tags", "Notes",
]
MOST_ROWS = 1_000_000  # what a sheet holds

#: workbook -> kinds of roles in it; None: all.
SPLITS: dict[str, tuple[str, ...] | None] = {
    "all": None,
    "internship": ("internship",),
    "working_student": ("working_student",),
    "thesis": ("thesis",),
    "hiwi": ("hiwi",),
    "regular_or_other": ("full_time_or_regular", "part_time_regular", "other"),
}


def export_rows(df: DataFrame, order: str, score: Column) -> DataFrame:
    """Display columns, with the order and score they are ranked by."""
    filled = lambda c: F.coalesce(t.strip(F.col(c)), F.lit(""))
    link = t.first_filled(F.col("apply_url"), F.col("source_job_url"), F.col("url"))
    scored = [c for c in ("llm_reason",) if c in df.columns]
    kind = t.role_kind(F.concat_ws(" ", "title", "employment_type_raw", *scored, "description_raw"), F.col("employment_type_raw"))
    of = lambda c: filled(c) if c in df.columns else F.lit("")
    tags = t.joined(F.col("llm_fit_tags")) if "llm_fit_tags" in df.columns else F.lit("")
    return df.select(
        F.col(order),
        F.lit("todo").alias("Status"),
        score.alias("Score"),
        of("llm_category").alias("Category"),
        kind.alias("Role Type"),
        filled("title").alias("Title"),
        filled("company").alias("Company"),
        filled("location_raw").alias("Location"),
        t.joined(F.col("sources")).alias("Role Source"),
        F.coalesce(link, F.lit("")).alias("Apply Link"),
        of("llm_reason").alias("Reason"),
        F.coalesce(tags, F.lit("")).alias("Tags"),
        F.lit("").alias("Notes"),
    )


def split_counts(rows: DataFrame) -> DataFrame:
    """(workbook, n) in one pass over the rows."""
    kinds = rows.groupBy(F.col("Role Type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))  # one row per kind
    books = F.array(
        *(F.struct(F.lit(book).alias("workbook"), (F.lit(True) if of is None else F.col("kind").isin(*of)).alias("fits")) for book, of in SPLITS.items())
    )
    return (
        kinds.select("n", F.inline(books))
        .groupBy("workbook")
        .agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("n"))), F.lit(0)).alias("n"))
    )


def write_splits(rows: DataFrame, order: str, folder: str, label: str = "run") -> list[str]:
    """One ranked workbook per split; a split beyond what a sheet holds is refused, not cut."""
    paths = []
    for book, of in SPLITS.items():
        own = rows if of is None else rows.where(F.col("Role Type").isin(*of))
        found = stable_ranking(own, "Score", order).limit(MOST_ROWS + 1).toLocalIterator()
        content = [r.asDict() for r in found]
        if len(content) > MOST_ROWS:
            raise ValueError(f"{book}: more rows than a sheet holds")
        widths = {r["column"]: r["width"] for r in column_widths(own, COLUMNS).collect()}
        path = os.path.join(folder, f"{label.strip().replace(' ', '_').lower()}_{book}.xlsx")
        write_workbook(content, COLUMNS, widths, path, link="Apply Link")
        paths.append(path)
    return paths
