"""Problem 6: clusters of photos that resemble each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.clustering import cluster_vectors, describe_clusters, exact_clusters
from gleanframe.llm.similar import _VECTORS, LEAST_COSINE, photo_vectors
from gleanframe.session import cut

LEAST_MEMBERS = 5


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(photo_vectors(spark, folder), "photo_id", "vector", LEAST_COSINE, LEAST_MEMBERS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _members(spark, folder).select("photo_id", "cluster_id")


def p6_described(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical photos of each cluster."""
    return describe_clusters(_members(spark, folder), "photo_id").withColumn("typical", F.array_join("typical", " "))


def p6_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the members that comparing every two vectors gives are found, and how many are found that aren't there."""
    vectors = cut(photo_vectors(spark, folder))
    exact = exact_clusters(vectors, "photo_id", "vector", LEAST_COSINE, LEAST_MEMBERS).withColumn("true", F.lit(1))
    found = cluster_vectors(vectors, "photo_id", "vector", LEAST_COSINE, LEAST_MEMBERS).select("photo_id", "cluster_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["photo_id", "cluster_id"], "full")
    counts = both.agg(F.count("true").alias("members"), F.count_if(F.col("true").isNotNull() & F.col("hit").isNotNull()).alias("found"), F.count_if(F.col("true").isNull()).alias("wrong"))
    return counts.withColumn("recall", F.try_divide("found", "members"))


QUERIES = {"p6_found": p6_found, "p6_described": p6_described, "p6_recall": p6_recall}
SQL = {
    "p6_found": f"""with {_VECTORS},
  near as (
    select a.photo_id, b.photo_id as other from vectors a join vectors b
    on round(array_cosine_similarity(a.v, b.v), 6) >= 0.85 or a.photo_id = b.photo_id),
  seen as (select photo_id, count(*) as n, min(other) as cluster_id, sum(cast(hash(other) as hugeint)) as h from near group by 1),
  grouped as (select cluster_id, n, h, count(*) as members from seen group by 1, 2, 3 having count(*) = n and n >= 5)
select s.photo_id, s.cluster_id from seen s join grouped g using (cluster_id, n, h)"""
}
