"""Scores of reviews and the use that calls made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_step(score: Column) -> Column:
    """The score, where it is from 0 to 10 in half steps; else NULL."""
    return F.when((score >= 0) & (score <= 10) & (score * 2 == F.floor(score * 2)), score)


def mean_score(scores: list[Column]) -> Column:
    """The mean of all scores, rounded half up to two places in decimal; NULL if one is missing."""
    total = sum((s.cast("decimal(6,2)") for s in scores[1:]), scores[0].cast("decimal(6,2)"))
    return F.round(total / F.lit(len(scores)).cast("decimal(4,0)"), 2)


def review_status(scores: list[Column]) -> Column:
    known = sum((s.isNotNull().cast("int") for s in scores[1:]), scores[0].isNotNull().cast("int"))
    return F.when(known == len(scores), "reviewed").when(known > 0, "partial").otherwise("unreviewable")


def usage_totals(calls: DataFrame, by: list[str], key: str, fields: list[str]) -> DataFrame:
    """Sums of each field over distinct calls; known only if every call has the field. ``observed_``: what was seen."""
    one = calls.groupBy(*by, key).agg(*(F.max(f).alias(f) for f in fields))
    total = [F.when(F.count(f) == F.count(F.lit(1)), F.sum(f)).alias(f"total_{f}") for f in fields]
    seen = [F.sum(f).alias(f"observed_{f}") for f in fields]
    return one.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *total, *seen)


def attempt_totals(rows: DataFrame, batch: str, attempt: str, newest: list[Column], amount: Column) -> DataFrame:
    """(batch, attempts, reported, total, complete): of several rows of an attempt the last by ``newest`` counts; ``total`` is
    NULL where no attempt has reported an amount, and complete where all have."""
    last = rows.groupBy(batch, attempt).agg(F.max_by(F.struct(amount.alias("amount")), F.struct(*newest))["amount"].alias("amount"))
    return last.groupBy(F.col(batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count("amount").alias("reported"), F.sum("amount").alias("total"), (F.count("amount") == F.count(F.lit(1))).alias("complete")
    )
