from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators import components
from gleanframe.operators.skew import heaviest, salted_join


def test_salted_join_equals_join(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k bigint, id bigint"))
    few = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    heavy = heaviest(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", at_once=100)
    assert [tuple(r) for r in heavy.collect()] == [(0, 20)]
    got = salted_join(rows, few, ["k"], heavy, F.col("id"))
    assert sorted(map(tuple, got.select("k", "id", "x").collect())) == sorted(map(tuple, rows.join(few, "k").select("k", "id", "x").collect()))
    nothing = heavy.limit(0)
    assert salted_join(rows, few, ["k"], nothing, F.col("id")).count() == got.count()


def test_half_the_rows_on_one_key_are_spread(spark):
    """The longest part of a hot key is under twice the median of all parts."""
    rows = spark.range(60000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    few = rows.select("k").distinct().withColumn("x", F.lit(1))
    heavy = heaviest(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", at_once=500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(rows, few, ["k"], heavy, F.col("id"))
        sizes = sorted(r[0] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).select("count(1)").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 60000 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_hub_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", 50)
    monkeypatch.setattr(components, "heaviest", lambda low, key, rows: heaviest(low, key, rows, at_once=50))
    star = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 40)] + [(5000, 5001), (5001, 5002), (7, 7), (None, 3)]
    labels = {r["v"]: r["label"] for r in components.connected_components(spark.createDataFrame(star, "u bigint, v bigint")).collect()}
    assert labels == {v: 0 for e in star[:-4] for v in e} | {5000: 5000, 5001: 5000, 5002: 5000}
