"""Runs over queues and postings: pools, resets, statistics, stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirelake.functions.text import first_filled
from hirelake.runtime import remove
from hirelake.streaming.pool import Pool


class Runs:
    """The state of a collecting application in a folder of a shared file system.

    pool: every posting ever seen, first sighting first; run: those of the current run; details: parsed
    postings, one per address as seen (or clean address). A new queue empties run and details, a new
    detail run empties details; the pool stays until clear().
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: int, order: str = "detail_id"):
        self.spark, self.folder, self.run_id = spark, folder, run_id
        self.pool = Pool(spark, f"{folder}/pool", "url", "seq")
        self.run = Pool(spark, f"{folder}/run", "url", "seq")
        self.details = Pool(spark, f"{folder}/details", first_filled(F.col("source_job_url"), F.col("url")), order)
        self.active: list[StreamingQuery] = []

    def _reset(self, *pools: Pool) -> None:
        for pool in pools:
            remove(self.spark, pool.folder)
            remove(self.spark, f"{pool.folder}-checkpoint")

    def start_queue(self, sightings: DataFrame) -> StreamingQuery:
        """Feed pool and run from a stream of sightings (seq, url, search_url, ...) whose pages follow one another."""
        self._reset(self.run, self.details)

        def add(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            self.pool._add(batch, number + self._offset)
            self.run._add(batch, number)
            batch.unpersist()

        known = self.pool.current()
        self._offset = 0 if known is None else known.agg(F.max("batch")).first()[0] + 1
        return self._started(sightings, add, f"{self.run.folder}-checkpoint")

    def start_details(self, postings: DataFrame) -> StreamingQuery:
        self._reset(self.details)
        return self._started(postings, self.details._add, f"{self.details.folder}-checkpoint")

    def _started(self, stream: DataFrame, add, checkpoint: str) -> StreamingQuery:
        query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        self.active.append(query)
        return query

    def stop(self) -> None:
        """Stop what runs, after the batch at hand."""
        for query in self.active:
            query.stop()
        self.active = []

    def to_parse(self) -> DataFrame | None:
        """What a detail run takes: the current run, or the whole pool where that is empty."""
        run = self.run.current()
        return run if run is not None and not run.isEmpty() else self.pool.current()

    def page_statistics(self, sightings: DataFrame) -> DataFrame:
        """(search_url, found, added_to_run, error): per page its sightings and those that the run first saw there."""
        run = self.run.current()
        first = sightings.select("search_url", "seq", "url")
        added = first.join(run.select("seq"), "seq") if run is not None else first.where(F.lit(False))
        found = sightings.groupBy("search_url").agg(F.count("url").alias("found"))
        new = added.groupBy("search_url").agg(F.count(F.lit(1)).alias("added_to_run"))
        error = F.when(F.col("found") == 0, "no postings found")
        return found.join(new, "search_url", "left").select("search_url", "found", F.coalesce("added_to_run", F.lit(0)).alias("added_to_run"), error.alias("error"))

    def status(self) -> dict:
        size = lambda pool: 0 if pool.current() is None else pool.current().count()
        return {"run_id": self.run_id, "running": any(q.isActive for q in self.active), "pool": size(self.pool), "run": size(self.run), "details": size(self.details)}

    def clear(self) -> None:
        """Forget everything."""
        self.stop()
        remove(self.spark, self.folder)
