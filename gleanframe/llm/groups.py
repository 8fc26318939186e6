"""Problem 1: groups of photos that look alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.ids import clean_id
from gleanframe.llm.consolidation import consolidate, group_sizes
from gleanframe.sources.tables import table

#: A pair links its photos up to this distance.
MAX_DISTANCE = 8.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "image_similarity_pairs", ["photo_id_a", "photo_id_b", "distance"])
    linked = pairs.where((F.col("distance") >= 0) & (F.col("distance") <= MAX_DISTANCE) & ~F.isnan("distance"))
    links = linked.select(clean_id("photo_id_a").alias("a"), clean_id("photo_id_b").alias("b"))
    return consolidate(links, "a", "b").withColumnRenamed("id", "photo_id")


def p1_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return group_sizes(p1_found(spark, folder))


_FOUND = """
select photo_id, min(other) as group_id from (
  with recursive links as (
    select distinct lower(trim(photo_id_a)) as a, lower(trim(photo_id_b)) as b from image_similarity_pairs
    where distance >= 0 and distance <= 8 and trim(photo_id_a) <> '' and trim(photo_id_b) <> ''
      and lower(trim(photo_id_a)) <> lower(trim(photo_id_b))),
  ways as (select a, b from links union select b, a from links),
  reach(photo_id, other) as (
    select a, a from ways union select r.photo_id, w.b from reach r join ways w on w.a = r.other)
  select * from reach)
group by photo_id
"""

QUERIES = {"p1_found": p1_found, "p1_group_sizes": p1_group_sizes}
SQL = {"p1_found": _FOUND, "p1_group_sizes": f"select group_id, count(*) as members from ({_FOUND}) group by 1"}
