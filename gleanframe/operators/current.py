"""The current row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(rows: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """The first row of each key by the order ``newest``; rows without a key are left out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest))
    return rows.where(F.col(key).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
