"""Problem 5: the photos most similar to every photo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.neighbours import every_nearest, exact_nearest, nearest_vectors, recall_against
from gleanframe.llm.vectors import current_vectors
from gleanframe.session import cut
from gleanframe.sources.tables import table

NEIGHBOURS = 5
LEAST_COSINE = 0.85


def photo_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return current_vectors(
        table(spark, folder, "image_embedding_results", ["photo_id", "profile_id", "result_id", "vector", "created_at"]),
        table(spark, folder, "image_embedding_profiles", ["profile_id", "created_at", "is_default"]),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest_vectors(photo_vectors(spark, folder), "photo_id", "vector", NEIGHBOURS, LEAST_COSINE)
    return near.select(F.least("photo_id", "neighbour").alias("photo_id_a"), F.greatest("photo_id", "neighbour").alias("photo_id_b")).distinct()


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar photos of every photo, however far: every two are compared, as far ones share no list."""
    return every_nearest(photo_vectors(spark, folder), "photo_id", "vector", NEIGHBOURS)


def p5_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the exact neighbours of the photos whose hash is divisible by 100 are found, from 0.85 on."""
    vectors = cut(photo_vectors(spark, folder))
    asked = vectors.where(F.pmod(F.xxhash64("photo_id"), F.lit(100)) == 0)
    exact = exact_nearest(vectors, asked, "photo_id", "vector", NEIGHBOURS).where(F.col("cosine") >= LEAST_COSINE)
    return recall_against(nearest_vectors(vectors, "photo_id", "vector", NEIGHBOURS, LEAST_COSINE), exact, "photo_id")


_VECTORS = """
  latest as (
    select photo_id, vector from (
      select lower(trim(r.photo_id)) as photo_id, r.vector, row_number() over (partition by lower(trim(r.photo_id))
             order by r.created_at desc nulls last, lower(trim(r.result_id)) desc nulls last) as k
      from image_embedding_results r
      where trim(r.photo_id) <> '' and lower(trim(r.profile_id)) = (
        select lower(trim(profile_id)) from image_embedding_profiles where is_default = 1 order by created_at desc, 1 limit 1))
    where k = 1),
  vectors as (
    select photo_id, cast(vector as double[64]) as v from latest
    where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(vector, lambda x: x <> 0)) > 0)
"""
_NEAREST = f"""with {_VECTORS},
  pairs as (
    select a.photo_id, b.photo_id as neighbour, round(least(1, greatest(-1, array_cosine_similarity(a.v, b.v))), 6) as cosine
    from vectors a join vectors b on a.photo_id <> b.photo_id),
  best as (select *, row_number() over (partition by photo_id order by cosine desc, neighbour) as rank from pairs)
"""

QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_recall": p5_recall}
SQL = {
    "p5_found": f"{_NEAREST} select distinct least(photo_id, neighbour) as photo_id_a, greatest(photo_id, neighbour) as photo_id_b from best where rank <= 5 and cosine >= 0.85",
    "p5_neighbours": f"{_NEAREST} select photo_id, neighbour, cosine, cast(rank as int) as rank from best where rank <= 5",
}
