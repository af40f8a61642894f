import pytest
from pyspark.sql import functions as F

from hirelake.operators import ordering


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbered_keeps_every_wide_row(spark, coalesce):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        rows = spark.range(200_000).select(F.col("id"), F.repeat(F.md5(F.col("id").cast("string")), 16).alias("wide"))
        found = ordering.numbered(rows, [F.col("id").desc()], "name", "row_%04d")
        right = F.col("name") == F.format_string("row_%04d", F.lit(200_000) - F.col("id"))
        got = found.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_if(right), F.count_if(F.length("wide") == 512)).first()
        assert tuple(got) == (200_000,) * 4
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_interleave_of_a_hot_key(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("key"))
    found = ordering.interleave(rows, "key", "id")
    want = rows.toPandas()
    want["turn"] = want.groupby("key", dropna=False).cumcount() + 1
    want["lane"] = want.groupby("key", dropna=False)["id"].transform("min")
    got = found.toPandas().sort_values("id").reset_index(drop=True)
    assert sorted(got.columns) == ["id", "key", "lane", "turn"]
    assert (got[["id", "turn", "lane"]].values == want[["id", "turn", "lane"]].values).all()


def test_ordering_of_empty_tables(spark):
    rows = spark.createDataFrame([], "id long, key string")
    assert ordering.numbered(rows, [F.col("id")], "name", "%d").collect() == []
    assert ordering.interleave(rows, "key", "id").collect() == []
