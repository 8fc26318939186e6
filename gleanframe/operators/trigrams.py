"""A trigram index over text: candidates by postings, confirmed by the literal itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.text import contains
from gleanframe.operators.snapshots import Stale

#: Folders that an index is divided into by its grams; a search reads those of its own grams.
BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def trigrams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key): the distinct runs of three characters of each text; NULL and shorter texts have none. No shuffle."""
    grams = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    return rows.select(F.explode(grams).alias("gram"), key)


def _sums(index: DataFrame, key: str) -> list[tuple]:
    n, s = F.count(F.lit(1)), F.sum(F.xxhash64("gram", key).cast("decimal(38,0)")).cast("string")
    return sorted(map(tuple, index.groupBy("bucket").agg(n, s).collect()))  # a row a bucket


def save_index(rows: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the index of ``rows`` to a new folder, and last what its buckets add up to: without that it isn't whole."""
    index = trigrams(rows, key, text).withColumn("bucket", _bucket(F.col("gram")))
    index.repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{path}/grams")
    spark = rows.sparkSession
    spark.createDataFrame(_sums(spark.read.parquet(f"{path}/grams"), key), "bucket int, grams bigint, sum string").coalesce(1).write.parquet(f"{path}/sums")


def open_index(spark: SparkSession, path: str, key: str, verify: bool = False) -> DataFrame:
    """(gram, key, bucket) of a saved index; with ``verify`` one that isn't what was written is an error."""
    index = spark.read.schema(f"gram string, `{key}` {dict(spark.read.parquet(f'{path}/grams').dtypes)[key]}, bucket int").parquet(f"{path}/grams")
    if verify and _sums(index, key) != sorted(map(tuple, spark.read.parquet(f"{path}/sums").collect())):
        raise Stale("the index isn't what was written")
    return index


def search(index: DataFrame, rows: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """(key) of the texts that contain ``literal``: those with all its trigrams, confirmed; of a shorter literal by scan. Of a
    saved index only the buckets of the literal's grams are read."""
    wanted = sorted({literal[j : j + 3] for j in range(len(literal) - 2)})
    if wanted:
        if "bucket" in index.columns:
            spark = index.sparkSession
            of = spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"))).distinct().collect()
            index = index.where(F.col("bucket").isin([r[0] for r in of]))
        found = index.where(F.col("gram").isin(wanted)).groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
        rows = rows.join(found.select(key), key, "left_semi")
    return rows.where(contains(F.col(text), literal)).select(key)
