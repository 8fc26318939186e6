"""Problem 2: subsets of photos that show the variety of the album."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.similar import photo_vectors
from gleanframe.llm.subset import choose_varied
from gleanframe.session import cut
from gleanframe.sources.tables import table


def p2_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """(request_id, subset_size, photo_id, rank) for each request; subsets are nested."""
    requests = table(spark, folder, "subset_requests", ["request_id", "subset_size"]).where("subset_size > 0").distinct()
    most = requests.agg(F.max("subset_size")).first()[0]
    ranked = choose_varied(photo_vectors(spark, folder), "photo_id", "vector", int(most or 0))
    return requests.join(ranked, F.col("rank") <= F.col("subset_size")).select("request_id", "subset_size", "photo_id", "rank")


def p2_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What no subset may have: another size than asked for (or than there are photos), a photo twice, one without a usable
    vector, ranks that aren't 1 to the size, or photos that a smaller subset has and it hasn't. There are none."""
    vectors = cut(photo_vectors(spark, folder).select("photo_id"))
    chosen = cut(p2_subsets(spark, folder))
    requests = table(spark, folder, "subset_requests", ["request_id", "subset_size"]).where("subset_size > 0").distinct()
    there = vectors.agg(F.count(F.lit(1)).alias("photos"))
    sizes = chosen.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("photo_id").alias("distinct"), F.count_distinct("rank").alias("ranks"), F.max("rank").alias("last")
    )
    asked = requests.crossJoin(F.broadcast(there)).join(sizes, "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # one row is broadcast
    wrong = asked.where("n <> least(subset_size, photos) or n > 0 and (distinct <> n or ranks <> n or last <> n)").select("request_id", F.lit("size").alias("fault"))
    unusable = chosen.join(vectors, "photo_id", "left_anti").select("request_id", F.lit("unusable").alias("fault"))
    a, b = chosen.alias("a"), chosen.alias("b")
    apart = a.join(b, (F.col("a.rank") == F.col("b.rank")) & (F.col("a.photo_id") != F.col("b.photo_id"))).select(F.col("a.request_id").alias("request_id"), F.lit("order").alias("fault"))
    return wrong.unionByName(unusable).unionByName(apart)


QUERIES = {"p2_subsets": p2_subsets, "p2_faults": p2_faults}
SQL = {"p2_faults": "select request_id, 'size' as fault from subset_requests where false"}
