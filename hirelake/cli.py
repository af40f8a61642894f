"""Command line: plan a queue, import parsed pages, list and run queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hirelake.operators import normalise, queue
from hirelake.plans import catalog
from hirelake.sinks.files import suffixed, write_json_document, write_jsonl
from hirelake.sources.files import latest_file, read_config, read_jsonl


def listed(text: str | None, divider: str) -> list[str] | None:
    return [part.strip() for part in text.split(divider) if part.strip()] or None if text else None


def write_queue(rows, outputs: dict, suffix: str | None) -> None:
    """The queue as a document and as lines, under the names that a field of a queue file has."""
    named = rows.withColumnsRenamed({"page_number": "pageNumber", "query_group": "queryGroup"})
    if outputs.get("json"):
        write_json_document(named, suffixed(outputs["json"], suffix), "place")
    if outputs.get("jsonl"):
        write_jsonl(named, suffixed(outputs["jsonl"], suffix), [F.col("place")])


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hirelake")
    commands = parser.add_subparsers(dest="command", required=True)
    plan = commands.add_parser("queue")
    plan.add_argument("config")
    plan.add_argument("--profile")
    plan.add_argument("--group", "--query-group")
    plan.add_argument("--sources", help="divided by commas")
    plan.add_argument("--locations", help="divided by |")
    plan.add_argument("--profile-locations", action="store_true")
    plan.add_argument("--max-pages", type=int)
    plan.add_argument("--max-per-source", type=int)
    plan.add_argument("--max-total", type=int)
    plan.add_argument("--output-suffix")
    plan.add_argument("--sample", type=int, default=10)
    plan.add_argument("--dry-run", action="store_true")
    load = commands.add_parser("import")
    load.add_argument("folder")
    load.add_argument("--input")
    load.add_argument("--output", required=True)
    run = commands.add_parser("query")
    run.add_argument("name", nargs="?")
    run.add_argument("folder", nargs="?")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if options.command == "queue":
        config = read_config(options.config)
        profile = read_config(options.profile) if options.profile else None
        chosen = queue.Plan(options.group, listed(options.sources, ","), listed(options.locations, "|"), options.profile_locations,
                            options.max_pages, options.max_per_source, options.max_total)
        rows = queue.planned_queue(spark, config, profile, chosen).persist()
        rows.groupBy("source").count().orderBy("source").show()
        rows.orderBy("place").select("place", "source", "query", "location", "url").limit(options.sample).show(truncate=False)
        if not options.dry_run:
            write_queue(rows, (config.get("run_safety") or {}).get("write_outputs") or {}, options.output_suffix or options.group)
    elif options.command == "import":
        from pyspark.sql import types as T

        strings = "url source_job_url source title company location_raw description_raw workplace_type_raw employment_type_raw apply_url".split()
        lists = "sources search_urls search_queries".split()
        schema = T.StructType([T.StructField(n, T.StringType()) for n in strings] + [T.StructField(n, T.ArrayType(T.StringType())) for n in lists])
        parsed = read_jsonl(spark, latest_file(options.folder, options.input), schema)
        write_jsonl(normalise.normalised(parsed), options.output)
    elif options.name and options.folder:
        catalog.queries()[options.name](spark, options.folder).show()
    else:
        print("\n".join(sorted(catalog.queries())))


if __name__ == "__main__":
    main()
