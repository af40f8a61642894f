"""Search queues from declarative configuration: expand, render, interleave, cap."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hirelake.functions.text import collapse, slugify
from hirelake.functions.urls import page_url, path_encoded, plus_encoded


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Filled values, each spelling once regardless of case, the first spelling kept: (value, order)."""
    rows = df.select(collapse(F.col(value)).alias(value), order).where(F.col(value) != "")
    first = rows.groupBy(F.lower(value).alias("__key")).agg(F.min(F.struct(order, value)).alias("__row"))
    return first.select(F.col(f"__row.{value}").alias(value), F.col(f"__row.{order}").alias(order))


def render(template: Column, context: dict[str, Column]) -> Column:
    """A template with its {name} slots filled."""
    out = template
    for name, value in context.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def context(query: Column, location: Column, location_slug: Column | None = None, **fixed) -> dict[str, Column]:
    """What a template's slots stand for; fixed: slots with one value for the whole queue."""
    slug = slugify(location)
    return {
        "query_plus": plus_encoded(query),
        "query_quote": path_encoded(query),
        "query_slug": slugify(query),
        "query": query,
        "location_plus": plus_encoded(location),
        "location_quote": path_encoded(location),
        "location_slug": F.coalesce(location_slug, slug) if location_slug is not None else slug,
        "location": location,
    } | {name: F.lit(str(value)) for name, value in fixed.items()}


def distinct_texts(values) -> list[str]:
    """Filled values with collapsed white space, each once regardless of case, the first spelling kept."""
    found: dict[str, str] = {}
    for text in (" ".join(str(v).split()) for v in values):
        if text:
            found.setdefault(text.casefold(), text)
    return list(found.values())


def role_labels(profile: dict | None, first_only: bool) -> list[str]:
    roles = ((profile or {}).get("target_search") or {}).get("role_types") or []
    labels = [r.get("labels") or [] for r in roles]
    return distinct_texts(x for some in labels for x in (some[:1] if first_only else some))


def query_texts(config: dict, group: str | None = None, profile: dict | None = None) -> list[str]:
    """The queries of a group; without one the listed ones; without those, roles by focus terms by templates."""
    generation = config.get("query_generation") or {}
    if group:
        groups = generation.get("query_groups") or {}
        if group not in groups:
            raise ValueError(f"unknown query group {group!r}; known: {', '.join(sorted(groups)) or 'none'}")
        return distinct_texts(groups[group])
    if generation.get("explicit_queries"):
        return distinct_texts(generation["explicit_queries"])
    templates = [t for t in generation.get("templates", ["{role} {focus}"]) if "{focus}" in t]
    terms = distinct_texts(generation.get("focus_terms") or [])
    alone = generation.get("include_role_only_queries", True)
    found: list[str] = []
    for role in role_labels(profile, generation.get("role_label_mode") == "first_label"):
        found += [role] * alone + [t.format(role=role, focus=f) for f in terms for t in templates]
    return distinct_texts(found)


@dataclass(frozen=True)
class Plan:
    """Choices that override a configuration; None leaves it as it is."""

    group: str | None = None
    sources: list[str] | None = None
    locations: list[str] | None = None
    profile_locations: bool = False
    pages: int | None = None
    per_source: int | None = None
    total: int | None = None


def ordered_sources(config: dict, wanted: list[str] | None = None) -> list[str]:
    """Enabled sources: those of discovery.source_order first, then the rest as configured."""
    known = config.get("sources") or {}
    order = (config.get("discovery") or {}).get("source_order") or []
    found = [s for s in order if s in known] + [s for s in known if s not in order]
    return [s for s in found if (known[s] or {}).get("enabled", False) and (not wanted or s in wanted)]


def plan_locations(config: dict, profile: dict | None, plan: Plan) -> list[str]:
    active = None if plan.profile_locations else (config.get("query_generation") or {}).get("active_locations")
    own = ((profile or {}).get("target_search") or {}).get("primary_locations") or []
    return distinct_texts(plan.locations or active or own)


def grid(queries: DataFrame, locations: DataFrame, sources: DataFrame, **fixed) -> DataFrame:
    """Every query at every location on every page of every source that knows the location.

    queries: (query, query_no); locations: (location, location_no); sources: (source, source_rank,
    template, pages, locations array or null, and where wanted slugs, a map of location to slug, and
    independent: only the one query "all"). All three come from configuration and are small.
    """
    known = F.col("locations").isNull() | (F.size("locations") == 0) | F.array_contains("locations", F.col("location"))
    asked = queries.withColumn("__alone", F.lit(False))
    if "independent" in sources.columns:
        alone = sources.sparkSession.createDataFrame([("all", 0, True)], "query string, query_no int, __alone boolean")
        asked = asked.unionByName(alone)
        sources = sources.withColumn("__alone", F.coalesce("independent", F.lit(False)))
    else:
        sources = sources.withColumn("__alone", F.lit(False))
    expanded = (
        sources.join(F.broadcast(asked), "__alone")
        .join(F.broadcast(locations), known)
        .withColumn("page_number", F.explode(F.sequence(F.lit(1), F.greatest("pages", F.lit(1)))))
    )
    slug = F.col("slugs")[F.col("location")] if "slugs" in sources.columns else None
    base = render(F.col("template"), context(F.col("query"), F.col("location"), slug, **fixed))
    return expanded.withColumn("url", page_url(base, F.col("source"), F.col("page_number"))).drop(
        "template", "pages", "locations", "slugs", "independent", "__alone"
    )


# What a configuration means that doesn't say so.
DEFAULTS = {"recent_days": 14, "radius_km": 30, "sort": "date"}
MOST_PER_SOURCE, MOST_TOTAL = 300, 1500


def planned_queue(spark: SparkSession, config: dict, profile: dict | None = None, plan: Plan = Plan()) -> DataFrame:
    """(place, source, source_name, query, location, page_number, url, generated_at, query_group), place from 1."""
    safety = config.get("run_safety") or {}
    configured = config.get("sources") or {}
    rows = []
    for rank, name in enumerate(ordered_sources(config, plan.sources)):
        own = configured[name]
        pages = int(plan.pages or own.get("max_pages_per_search") or safety.get("max_pages_per_search") or 1)
        rows.append((name, rank, own.get("display_name", name), own["url_template"], pages, own.get("supported_locations"),
                     own.get("location_slug_overrides") or {}, bool(own.get("query_independent"))))
    sources = spark.createDataFrame(
        rows,
        "source string, source_rank int, source_name string, template string, pages int, locations array<string>, "
        "slugs map<string,string>, independent boolean",
    )
    numbered = lambda values, name: spark.createDataFrame(
        [(v, n) for n, v in enumerate(values)], T.StructType.fromDDL(f"{name} string, {name}_no int")
    )
    queries = numbered(query_texts(config, plan.group, profile), "query")
    found = grid(queries, numbered(plan_locations(config, profile, plan), "location"), sources, **(DEFAULTS | (config.get("defaults") or {})))
    found = found.withColumn("lane_key", F.concat_ws(" | ", "query", "location")).withColumn(
        "seq", F.struct("query_no", "location_no", "page_number")
    )
    most = int(plan.per_source or safety.get("max_urls_per_source") or MOST_PER_SOURCE), int(plan.total or safety.get("max_total_urls") or MOST_TOTAL)
    return fair_queue(found, "lane_key", "seq", *most).select(
        "place", "source", "source_name", "query", "location", "page_number", "url",
        F.lit(datetime.now(timezone.utc).isoformat()).alias("generated_at"), F.lit(plan.group or "all").alias("query_group"),
    )


def fair_queue(rows: DataFrame, key: str, order: str, per_source: int, total: int) -> DataFrame:
    """Interleave each source's rows by key, cap each source, cap all in source order, interleave sources.

    rows: source, source_rank, key, order. Adds place, the position in the queue from 1. The windows
    over all rows see at most per_source rows of each source.
    """
    within = Window.partitionBy("source", key).orderBy(order)
    lanes = Window.partitionBy("source", key)
    lined = rows.withColumn("turn", F.row_number().over(within)).withColumn("lane", F.min(order).over(lanes))
    capped = lined.withColumn("slot", F.row_number().over(Window.partitionBy("source").orderBy("turn", "lane"))).where(
        F.col("slot") <= per_source
    )
    admitted = capped.orderBy("source_rank", "slot").limit(total)
    return admitted.withColumn("place", F.row_number().over(Window.orderBy("slot", "source_rank"))).drop("turn", "lane", "slot")
