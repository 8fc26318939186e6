"""Numbers, ranks and pages over an order of all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import cut


#: Rows that a page may have.
LEAST_PAGE, MOST_PAGE = 1, 1000


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their place, from 1, in the order of all rows (which should be total).

    Rows are range-partitioned and sorted in their partitions; the partitions' sizes, one number each, give the offsets.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    kept = cut(spread.withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(map(tuple, kept.groupBy(part.alias("part")).count().collect()))
    return _with_offset(kept, part, sizes).withColumn(name, F.col("_offset") + place + 1).drop("_at", "_offset")


def _with_offset(kept: DataFrame, part: Column, amounts: list[tuple[int, int]]) -> DataFrame:
    """``kept`` with ``_offset``: what the partitions before a row's own amount to; a row a partition is broadcast."""
    offsets, before = [], 0
    for p, n in amounts:
        offsets.append((p, before))
        before += n
    table = kept.sparkSession.createDataFrame(offsets, "_before bigint, _offset bigint")
    return kept.join(F.broadcast(table), part.cast("bigint") == F.col("_before")).drop("_before")


def ranked_with_gaps(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of greatest score (ties by key) with rank, gap from the best and gap to the next (NULL on the last)."""
    top = rows.orderBy(F.col(score).desc(), key).limit(k + 1)
    w = Window.orderBy(F.col(score).desc(), key)  # over k + 1 rows
    return top.select(
        "*",
        F.row_number().over(w).alias("rank"),
        (F.first(score).over(w) - F.col(score)).alias("gap_from_best"),
        (F.col(score) - F.lead(score).over(w)).alias("gap_to_next"),
    ).where(F.col("rank") <= k)


def average_rank_percentile(rows: DataFrame, group: str, key: str, score: str, lower: Column | None = None, exact: Column | None = None) -> DataFrame:
    """``rows`` with ``normalized``: the mean place of a row's score among its group, from 0 to 1; 1 where the group has one
    score only. NaN scores must be filtered out before.

    ``lower``: whether lower scores are better in the row's group; ``exact``: whether scores only say yes, so all rows have 1.
    """
    better = F.when(F.coalesce(F.lit(False) if lower is None else lower, F.lit(False)), -F.col(score)).otherwise(F.col(score))
    placed = numbered(rows.withColumn("_score", better), [F.col(group), F.col("_score"), F.col(key)], "_n")
    ties = placed.groupBy(group, "_score").agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    total = placed.groupBy(group).agg(F.min("_n").alias("_start"), F.count(F.lit(1)).alias("_count"))
    mean = (F.col("_first") + F.col("_last") - 2 * F.col("_start")) / (2 * (F.col("_count") - 1))
    whole = (F.col("_last") - F.col("_first") + 1) == F.col("_count")
    if exact is not None:
        whole = whole | F.coalesce(exact, F.lit(False))
    return (
        placed.join(ties, [group, "_score"]).join(total, group)
        .withColumn("normalized", F.when(whole, 1.0).otherwise(mean))
        .drop("_n", "_first", "_last", "_start", "_count", "_score")
    )


def keyset_page(rows: DataFrame, key: str, after, size: int, descending: bool = False) -> DataFrame:
    """Up to ``size`` rows (1 to 1000) beyond ``after`` by key, with ``next_cursor`` (the last key, where more rows follow, else
    NULL)."""
    if isinstance(size, bool) or not isinstance(size, int) or not LEAST_PAGE <= size <= MOST_PAGE:
        raise ValueError(f"a page has {LEAST_PAGE} to {MOST_PAGE} rows")
    if after is not None:
        rows = rows.where(F.col(key) < after if descending else F.col(key) > after)
    order = F.col(key).desc() if descending else F.col(key).asc()
    page = rows.orderBy(order).limit(size + 1)
    place = F.row_number().over(Window.orderBy(order))  # over size + 1 rows
    every = Window.partitionBy(F.lit(1))
    marked = page.withColumn("_place", place).withColumn("_rows", F.count(F.lit(1)).over(every))
    last = F.max(F.when(F.col("_place") == size, F.col(key))).over(every)
    return marked.withColumn("next_cursor", F.when(F.col("_rows") > size, last)).where(F.col("_place") <= size).drop("_place", "_rows")


def monotone_times(rows: DataFrame, group: str, order: list[Column], time: str, name: str = "stamp") -> DataFrame:
    """``rows`` with a time that grows strictly in the order of their group: their own, or a microsecond after the one before."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ahead = F.unix_micros(F.col(time).cast("timestamp")) - place
    latest = F.max("_ahead").over(Window.partitionBy(group).orderBy("_place"))
    return rows.withColumns({"_place": place, "_ahead": ahead}).withColumn(name, F.timestamp_micros(latest + F.col("_place"))).drop("_place", "_ahead")


def running_total(rows: DataFrame, order: list[Column], amount: str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``amount`` (not NULL) over all rows that stand before in the order of all rows."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = cut(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = sorted(map(tuple, kept.groupBy("_part").agg(F.sum(amount).cast("bigint")).collect()))
    start = F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("bigint")
    return _with_offset(kept.withColumn(name, start), F.col("_part"), totals).withColumn(name, F.col(name) + F.col("_offset")).drop("_at", "_part", "_offset")
