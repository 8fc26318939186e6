"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins.
AT_ONCE = 1 << 17

#: Keys that are split, at most: any other key holds less than this part of all rows, and the table of them is broadcast.
MOST_HEAVY = 4096


def heaviest(counted: DataFrame, key: list[str], rows: str, at_once: int = AT_ONCE) -> DataFrame:
    """(key, salts) of the keys of ``counted`` (one row a key) that have more than ``at_once`` rows, the heaviest
    ``MOST_HEAVY`` of them: into how many parts their rows are to be divided."""
    heavy = counted.where(F.col(rows) > at_once).select(*key, F.least(F.ceil(F.col(rows) / at_once), F.lit(1 << 16)).cast("int").alias("salts"))
    return heavy.orderBy(F.col("salts").desc(), *key).limit(MOST_HEAVY)


def salted_join(rows: DataFrame, few: DataFrame, key: list[str], heavy: DataFrame, spread: Column) -> DataFrame:
    """The inner join of ``rows`` with ``few``, in which the rows of keys in ``heavy`` (as ``heaviest`` gives it) are divided
    by a hash of ``spread`` and their rows of ``few`` repeated for each part. Keys that are NULL match nothing."""
    part = F.pmod(F.xxhash64(F.lit("part"), spread), F.coalesce("salts", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(heavy), key, "left").withColumn("_part", part).drop("salts")
    right = few.join(F.broadcast(heavy), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*key, "_part"]).drop("_part")
