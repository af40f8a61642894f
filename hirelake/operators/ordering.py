"""Operators that depend on the order of rows: interleaving, caps, positions, merges of pools.

Every table carries an ordinal; nothing relies on the order of partitions. Windows over the whole
table are used only on results that a cap has bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.runtime import cut


def distinct_by_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row by order of each key; a hash aggregate, so copies are combined before the shuffle."""
    columns = df.columns
    rest = [c for c in columns if c != order]
    kept = df.groupBy(key.alias("__key")).agg(F.min(F.struct(F.col(order), *rest)).alias("__row"))
    return kept.select("__row.*").select(*columns)


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows sorted over range partitions, with their range in __part and their place in it in __at.

    Both numbers are written out with the rows: ranges are drawn from samples, so a second plan of the
    same sort may draw others.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut(ordered.withColumn("__at", F.monotonically_increasing_id()))
    return fixed.withColumn("__part", F.shiftright("__at", 33))


def interleave(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds turn and lane: rows taken one from each key in turn, keys in the order they first occur.

    Sorting by (turn, lane) gives the interleaved order. A frequent key spreads over as many ranges as
    it has rows for; turns are counted per key and range, and the counts of earlier ranges added.
    """
    placed = _placed(df, [F.col(key), F.col(order)])
    runs = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"), F.min(order).alias("__least")
    )
    earlier = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    runs = runs.withColumn("lane", F.min("__least").over(Window.partitionBy("__key"))).drop("__rows", "__least")
    same = placed[key].eqNullSafe(runs["__key"]) & (placed["__part"] == runs["__of"])
    found = placed.join(runs, same).withColumn("turn", F.col("__at") - F.col("__first") + F.col("__before") + 1)
    return found.drop("__key", "__of", "__part", "__at", "__first", "__before")


def cap_per_group(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, by order, with their position in it."""
    position = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("position", position).where(F.col("position") <= most)


def cap_total(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows altogether: a top-k, which never gathers more than k rows in one task."""
    return df.orderBy(*order).limit(most)


def numbered(df: DataFrame, order: list[Column], name: str, pattern: str) -> DataFrame:
    """A positional name for each row.

    Positions come from counts of range partitions and places within them, not from one global window.
    """
    placed = _placed(df, order)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", "__first", before.alias("__before"))  # one row per range
    position = (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("bigint")
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.format_string(pattern, position)).drop("__part", "__at", "__first", "__before")


def merge_pool(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old rows and those new ones whose key isn't among them.

    Of old rows with one key the last counts, at the place of the first; of new rows the first.
    """
    others = [c for c in old.columns if c not in (key, order)]
    latest = old.groupBy(key).agg(F.min(order).alias(order), F.max(F.struct(F.col(order), *others)).alias("__last"))
    kept = latest.select(key, order, *(F.col(f"__last.{c}").alias(c) for c in others)).select(*old.columns)
    fresh = distinct_by_key(new.where(F.col(key).isNotNull()), F.col(key), order).join(kept.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*old.columns))


def per_group_top(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return cap_per_group(df, group, order, k).drop("position")


def stable_ranking(df: DataFrame, score: str, order: str) -> DataFrame:
    """Rows by score downwards, ties as they came."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(0)).desc(), F.col(order).asc())
