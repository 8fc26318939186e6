"""References to records that do not exist.

Parent keys become integers, sorted integers become runs ``[first, last]`` of consecutive keys, and each referred key is
matched as of the run that starts at or before it: a key beyond that run's end has no parent. Runs carry the latest
creation time in them, so that a reference older than its target is found with the same match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.ids import clean_id, integer_key
from gleanframe.operators.skew import heaviest, salted_join
from gleanframe.session import cut

#: Integer keys in one window partition: runs are cut at multiples of it, which bounds what one sort group holds.
BUCKET = 1 << 16


@dataclass(frozen=True)
class Reference:
    """One referring column: its table, the record's own key, the key referred to, the row's time and the target."""

    table: str
    rows: DataFrame
    record_key: str
    ref_key: str
    time: str
    target: str


def live_parents(target: str, rows: DataFrame, key: str, created: str, removed: DataFrame | None) -> DataFrame:
    """``(target, ref_key, created_at)`` of a target table, one row a key, without keys removed since.

    A key is removed when the latest ``removed_at`` of it is not before its creation; a key without a creation time is
    removed by any entry. Of several rows of a key the earliest creation counts.
    """
    parents = (
        rows.select(clean_id(key).alias("ref_key"), F.col(created).alias("created_at"))
        .where("ref_key is not null")
        .groupBy("ref_key")
        .agg(F.min("created_at").alias("created_at"))
    )
    if removed is not None:
        gone = (
            removed.where(clean_id("table_name") == target)
            .select(clean_id("key_value").alias("ref_key"), "removed_at")
            .where("ref_key is not null")
            .groupBy("ref_key")
            .agg(F.max("removed_at").alias("removed_at"))
        )
        parents = (
            parents.join(gone, "ref_key", "left")
            .where("removed_at is null or removed_at < created_at")
            .drop("removed_at")
        )
    return parents.select(F.lit(target).alias("target"), "ref_key", "created_at")


def _coded(df: DataFrame) -> DataFrame:
    space, number = integer_key(F.col("ref_key"))
    return df.withColumns({"space": space, "number": number}).withColumn("bucket", F.floor(F.col("number") / BUCKET))


def key_runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs ``(target, space, bucket, first, last, newest)`` of the integer keys of ``parents``."""
    cell = ["target", "space", "bucket"]
    numbered = _coded(parents).withColumn(
        "island", F.col("number") - F.row_number().over(Window.partitionBy(*cell).orderBy("number"))
    )
    return numbered.groupBy(*cell, "island").agg(
        F.min("number").alias("first"),
        F.max("number").alias("last"),
        F.max("created_at").alias("newest"),
    ).drop("island")


def unmatched_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """Keys of ``references`` (target, ref_key, time) with no parent, or with one that may be newer than a reference.

    Returns ``(target, ref_key, rows, missing, newest)``, ``rows`` being how many refer to the key. References are first reduced to one row a key, map-side, so that a key
    holding a large share of all references costs no more than any other.
    """
    cell = ["target", "space", "bucket"]
    keys = _coded(references.groupBy("target", "ref_key").agg(F.min("time").alias("oldest"), F.count(F.lit(1)).alias("rows")))
    runs = key_runs(parents)
    both = runs.select(*cell, F.col("first").alias("at"), F.lit(0).alias("kind"), F.struct("last", "newest").alias("run"), F.lit(None).cast("string").alias("ref_key"), F.lit(None).cast("timestamp_ntz").alias("oldest"), F.lit(None).cast("bigint").alias("rows")).unionByName(
        keys.select(*cell, F.col("number").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<last:bigint,newest:timestamp_ntz>").alias("run"), "ref_key", "oldest", "rows")
    )
    as_of = Window.partitionBy(*cell).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("preceding", F.last("run", ignorenulls=True).over(as_of)).where("kind = 1")
    missing = F.coalesce(F.col("at") > F.col("preceding.last"), F.lit(True))
    return (
        matched.select("target", "ref_key", "rows", "oldest", missing.alias("missing"), F.col("preceding.newest").alias("newest"))
        .where(F.col("missing") | (F.col("newest") > F.col("oldest")))
        .drop("oldest")
    )


def month_of(time: Column) -> Column:
    """``YYYY-MM`` of a time read as UTC, ``unknown`` without one."""
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("unknown"))


def orphan_references(references: list[Reference], parents: list[DataFrame]) -> DataFrame:
    """Each reference without a valid target as ``(table_name, record_key, ref_key, period_month)``, distinct rows.

    A reference is reported when its key has no live parent or the parent was created after the referring row. A NULL,
    empty or blank reference refers to nothing and is no case; a row without a time is never too early and its month is
    ``unknown``; a record key that is NULL or blank is reported as NULL. Empty tables give no rows; other columns of the
    tables are never read.
    """
    rows = None
    for r in references:
        part = r.rows.select(
            F.lit(r.table).alias("table_name"),
            F.lit(r.target).alias("target"),
            clean_id(r.record_key).alias("record_key"),
            clean_id(r.ref_key).alias("ref_key"),
            F.col(r.time).cast("timestamp_ntz").alias("time"),
        ).where("ref_key is not null")
        rows = part if rows is None else rows.unionByName(part)
    targets = parents[0]
    for p in parents[1:]:
        targets = targets.unionByName(p)
    suspects = unmatched_keys(targets, rows.select("target", "ref_key", "time"))
    # Runs of several keys only know their newest creation; the exact time of a suspect's own parent decides.
    exact = cut(
        suspects.join(targets, ["target", "ref_key"], "left")
        .select("target", "ref_key", "rows", "missing", "created_at")
    )
    # A key that many rows refer to in vain would bring them all into one task.
    heavy = heaviest(exact, ["target", "ref_key"], "rows")
    return (
        salted_join(rows, exact.drop("rows"), ["target", "ref_key"], heavy, F.struct("record_key", "time"))
        .where(F.col("missing") | (F.col("created_at") > F.col("time")))
        .select("table_name", "record_key", "ref_key", month_of(F.col("time")).alias("period_month"))
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table and month: references, distinct records and distinct missing keys."""
    return orphans.groupBy("table_name", "period_month").agg(
        F.count(F.lit(1)).alias("references"),
        F.count_distinct("record_key").alias("records"),
        F.count_distinct("ref_key").alias("missing_keys"),
    )
