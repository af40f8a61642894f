"""Streams of sightings: pools that keep the first of each key, and statistics per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirelake.operators.ordering import distinct_by_key
from hirelake.runtime import listed


def first_seen_batch(df: DataFrame, key: str, order: str) -> DataFrame:
    return distinct_by_key(df.where(F.col(key).isNotNull()), F.col(key), order)


class Pool:
    """A growing table with the first row of each key, fed by a stream.

    Each micro-batch is reduced to its first rows by key, then to keys that the pool hasn't, and
    written as a folder of its own named after the batch; a batch that is run again overwrites its
    folder, so a lost and repeated batch leaves the pool as it was. The folder may be on any file system
    Spark writes to. Of the pool, a batch reads the key column only.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str | Column, order: str):
        """key: a column's name, or an expression, which the pool then keeps as pool_key."""
        self.spark, self.folder, self.order = spark, folder, order
        self.key, self.expression = (key, None) if isinstance(key, str) else ("pool_key", key)
        self.rows, self.stats = f"{folder}/rows", f"{folder}/stats"

    def current(self, below: int | None = None) -> DataFrame | None:
        if not any(n.startswith("batch=") for n in listed(self.spark, self.rows)):
            return None
        found = self.spark.read.parquet(self.rows)
        return found.where(F.col("batch") < below) if below is not None else found

    def _add(self, batch: DataFrame, number: int) -> None:
        if self.expression is not None:
            batch = batch.withColumn(self.key, self.expression)
        first = first_seen_batch(batch, self.key, self.order).persist()
        known = self.current(below=number)
        fresh = first if known is None else first.join(known.select(self.key), self.key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.rows}/batch={number}")
        added = self.spark.read.parquet(f"{self.rows}/batch={number}").count()
        seen = batch.agg(F.count(F.lit(1)).alias("found"), F.lit(added).alias("added"))
        seen.write.mode("overwrite").parquet(f"{self.stats}/batch={number}")
        first.unpersist()

    def feed(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run what is available, batch by batch."""
        return (
            stream.writeStream.foreachBatch(self._add)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def statistics(self) -> DataFrame:
        """(batch, found, added)."""
        return self.spark.read.parquet(self.stats)


def page_statistics(df: DataFrame) -> DataFrame:
    """Rows found, distinct postings and rows without a title per run and page of a batch table."""
    return df.groupBy("run_id", "search_url").agg(
        F.count(F.lit(1)).alias("found"), F.count_distinct("url").alias("distinct_urls"), F.count_if(F.col("title").isNull()).alias("untitled")
    )
