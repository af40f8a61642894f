"""Scoring by an external service: prompts, requests, cache, parsing of answers, scored rows, accounts.

The service is a client object handed in; without one, answers come from a cache table or a replay.
A failing record becomes an error row and never ends a job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.runtime import listed

ATTEMPTS = 3
MOST_WAIT = 10
SCORED = "key string, answer string, error string"


@dataclass(frozen=True)
class Service:
    """Where and how a chat service is asked. The key is kept out of plans, columns and printouts."""

    base_url: str
    model: str
    system: str
    key: str = field(default="", repr=False)
    temperature: float = 0.1
    most_tokens: int = 320
    thinking: str = "disabled"
    timeout: float = 90

    def payload(self, prompt: str) -> dict:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        return {
            "model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.most_tokens,
            "thinking": {"type": self.thinking},
        }

    def __call__(self, prompt: str) -> str:
        """The body of the service's answer."""
        data = json.dumps(self.payload(prompt), ensure_ascii=False).encode()
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        request = Request(f"{self.base_url.rstrip('/')}/chat/completions", data=data, headers=headers, method="POST")
        try:
            with urlopen(request, timeout=self.timeout) as response:
                return response.read().decode("utf-8", errors="replace")
        except HTTPError as failure:
            raise RuntimeError(f"HTTP {failure.code}: {failure.read().decode('utf-8', errors='replace')[:800]}") from failure


def prompt_of(profile: str, job: Column, task: str) -> Column:
    """The question about one record: a JSON text of the profile as it is, the record and the task."""
    fields = F.struct(F.lit(profile).alias("candidate_profile_yaml"), job.alias("job"), F.lit(task).alias("task"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def unwrapped(body: Column) -> Column:
    """struct(content, usage, error) of a chat service's answer: the first choice's message."""
    parsed = F.try_parse_json(body)
    text = lambda path: F.coalesce(F.try_variant_get(parsed, path, "string"), F.lit(""))
    content, reasoning = text("$.choices[0].message.content"), text("$.choices[0].message.reasoning_content")
    count = lambda name: F.coalesce(F.try_variant_get(parsed, f"$.usage.{name}", "bigint"), F.lit(0)).alias(name)
    error = (
        F.when(body.isNull(), F.lit(None))
        .when(parsed.isNull(), F.concat(F.lit("no JSON: "), F.left(body, F.lit(800))))
        .when(F.try_variant_get(parsed, "$.choices[0].message", "variant").isNull(), F.lit("no message"))
        .when((F.trim(content) == "") & (reasoning != ""), F.lit("empty content beside reasoning"))
        .when(answer_object(content).isNull(), F.concat(F.lit("no object: "), F.left(content, F.lit(800))))
    )
    usage = F.struct(count("prompt_tokens"), count("completion_tokens"), count("total_tokens"))
    return F.struct(F.when(error.isNull() & body.isNotNull(), content).alias("content"), usage.alias("usage"), error.alias("error"))


def request_key(model: Column, profile: Column, *fields: str, version: int = 2) -> Column:
    """A hash of everything an answer depends on, in a canonical form; positions aren't part of it."""
    body = [x for f in sorted(fields) for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))]
    return F.sha2(F.concat_ws("\x1f", model, profile, *body, F.lit(str(version))), 256)


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with answers, requests without)."""
    hits = requests.join(cache.select("key", "answer").dropDuplicates(["key"]), "key")
    return hits, requests.join(cache.select("key"), "key", "left_anti")


def score(requests: DataFrame, client: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, answer, error) of requests (key, prompt), each tried up to ATTEMPTS times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, prompt in zip(rows["key"], rows["prompt"]):
                answer = error = None
                for attempt in range(1, ATTEMPTS + 1):
                    try:
                        answer, error = client(prompt), None
                        break
                    except Exception as failure:  # noqa: BLE001
                        error = f"{type(failure).__name__}: {failure}"[:240]
                        sleep(min(2**attempt, MOST_WAIT))
                out.append((key, answer, error))
            yield pd.DataFrame(out, columns=["key", "answer", "error"])

    return requests.select("key", "prompt").mapInPandas(run, SCORED)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of a cache folder, empty where nothing has been put yet."""
    schema = "key string, answer string"
    return spark.read.schema(schema).parquet(path) if listed(spark, path) else spark.createDataFrame([], schema)


def put_cache(answers: DataFrame, path: str) -> None:
    """Append the answers without an error; failures are asked again another time."""
    answers.where(F.col("error").isNull() & F.col("answer").isNotNull()).select("key", "answer").write.mode("append").parquet(path)


def answered(requests: DataFrame, cache_path: str, client: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, answer, error, cache_hit) for requests (key, prompt): from the cache, else from the service, once per key.

    New answers are written before they are read back, so no request is asked twice when a later step is repeated.
    """
    spark = requests.sparkSession
    once = requests.select("key", "prompt").dropDuplicates(["key"])
    hits, misses = cached(once, read_cache(spark, cache_path))
    asked = score(misses, client, sleep).withColumn("unwrapped", unwrapped(F.col("answer")))
    asked = asked.select("key", "answer", F.coalesce("error", "unwrapped.error").alias("error")).persist()
    put_cache(asked, cache_path)
    failed = asked.where(F.col("error").isNotNull()).select("key", F.lit(None).cast("string").alias("answer"), "error", F.lit(False).alias("cache_hit"))
    fresh = asked.where(F.col("error").isNull()).select("key", "answer", "error", F.lit(False).alias("cache_hit"))
    known = hits.select("key", "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cache_hit"))
    return known.unionByName(fresh).unionByName(failed)


def scored_rows(candidates: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """Candidates (with key) and what their answers say; a failing record has its error and no score."""
    said = candidates.join(answers, "key", "left").withColumn("u", unwrapped(F.col("answer")))
    said = said.withColumn("v", answer_object(F.col("u.content"))).withColumn("failure", F.coalesce("error", "u.error", F.when(F.col("v").isNull(), "no answer")))
    ok = F.col("failure").isNull()
    text = lambda name: F.coalesce(F.try_variant_get(F.col("v"), f"$.{name}", "string"), F.lit(""))
    return said.select(
        *(c for c in candidates.columns if c != "key"),
        F.lit(model).alias("llm_model"),
        F.when(ok, answer_number(F.col("v"), "score", 0, 10)).alias("llm_score"),
        F.when(ok, F.lower(F.trim(text("category")))).otherwise("llm_error").alias("llm_category"),
        F.when(ok, F.left(text("reason"), F.lit(240))).otherwise(F.concat(F.lit("llm_error: "), "failure")).alias("llm_reason"),
        F.when(ok, answer_tags(F.col("v"), "fit_tags")).otherwise(F.array().cast("array<string>")).alias("llm_fit_tags"),
        F.coalesce("cache_hit", F.lit(False)).alias("llm_cache_hit"),
        F.col("failure").alias("llm_error"),
        F.col("u.usage").alias("llm_usage"),
    )


def errors(scored: DataFrame, key: str) -> DataFrame:
    """(key, error) of the records that have no score."""
    return scored.where(F.col("llm_error").isNotNull()).select(key, F.col("llm_error").alias("error"))


def answer_object(text: Column) -> Column:
    """The JSON object in an answer, fenced or between other words, as a variant; null where there is none."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def answer_number(answer: Column, name: str, low: int, high: int) -> Column:
    """A whole number within bounds: numbers are truncated, truth values are 0 and 1, other text counts as low."""
    value = F.try_variant_get(answer, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(answer, f"$.{name}", "string")
    number = (
        F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("double")))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double"))
    )
    bounded = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.coalesce(number, F.lit(float(low)))))
    return F.when(bounded < 0, F.ceil(bounded)).otherwise(F.floor(bounded)).cast("bigint")


def answer_tags(answer: Column, name: str, most: int = 5, length: int = 40) -> Column:
    tags = F.coalesce(F.try_variant_get(answer, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(tags, lambda x: F.left(x, F.lit(length))), lambda x: F.trim(x) != ""), 1, most)


def accounts(scored: DataFrame, cached_column: str, counters: list[str]) -> DataFrame:
    """Sums of counters, of new and of cached answers apart; null counts as 0."""
    sums = [F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(c) for c in counters]
    return scored.groupBy(F.coalesce(cached_column, F.lit(False)).alias(cached_column)).agg(F.count(F.lit(1)).alias("answers"), *sums)
