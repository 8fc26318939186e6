"""Item versions: differences of scans, coverage of evidence, plans of work, merges and dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.session import cut


def scan_diff(before: DataFrame, now: DataFrame, key: str, version: str, state: str | None = None, complete: bool = True, failed: str | None = None) -> DataFrame:
    """(key, change): added, updated, restored, unchanged, failed, and missing if the scan was complete.

    ``failed``: a column of ``now``, true for items that were there but couldn't be read. ``state``: a column of ``before`` that is ``missing`` for items that were gone; one that is back is restored.
    """
    old = before.select(key, F.col(version).alias("_old"), (F.col(state) if state else F.lit("available")).alias("_state"), F.lit(1).alias("_was"))
    new = now.select(key, F.col(version).alias("_new"), (F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)).alias("_failed"), F.lit(1).alias("_is"))
    change = (
        F.when(F.col("_failed"), "failed")
        .when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "missing")
        .when(F.col("_state") == "missing", "restored")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("updated")
    )
    found = old.join(new, key, "full").select(key, change.alias("change"))
    return found if complete else found.where("change <> 'missing'")


def coverage(items: DataFrame, results: DataFrame, item: str, key: list[str], valid: str = "valid") -> DataFrame:
    """(item, coverage): ready where a valid result has the item's exact input ``key``, invalid_result where only an
    invalid one does, stale where only other inputs have results, else missing."""
    exact = results.groupBy(item, *key).agg(F.bool_or(F.coalesce(valid, F.lit(False))).alias("_valid"))
    other = results.select(item, F.lit(1).alias("_other")).distinct()
    found = items.select(item, *key).join(exact, [item, *key], "left").join(other, item, "left")
    status = F.when(F.col("_valid"), "ready").when(~F.col("_valid"), "invalid_result").when(F.col("_other").isNotNull(), "stale").otherwise("missing")
    return found.select(item, status.alias("coverage"))


def dependency_coverage(results: DataFrame, items: DataFrame, sources: DataFrame, inputs: list[str], recorded: list[str]) -> DataFrame:
    """(result_id, coverage, upstream) of results that were made from other results.

    ``results``: (result_id, item, source_id, …inputs, …recorded); ``items``: (item, usable, …inputs) as they are now; ``sources``:
    (source_id, valid, …inputs, …recorded), one row an id. An item that can't be an input makes ``invalid_input``. A source that is
    missing, isn't valid or was made from other inputs makes ``dependency_missing``, with what is wrong with it as ``upstream``. A result of other
    inputs or of another state of its source is ``stale``, any other ``ready``.
    """
    now = items.select("item", "usable", *(F.col(i).alias(f"_now_{i}") for i in inputs))
    source = sources.select("source_id", F.col("valid").alias("_valid"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_of_{c}") for c in [*inputs, *recorded]))
    found = results.join(now, "item", "left").join(source, "source_id", "left")
    same = lambda a, b, names: reduce(lambda x, y: x & y, (F.coalesce(F.col(f"{a}{n}") == F.col(f"{b}{n}"), F.lit(False)) for n in names))
    upstream = (
        F.when(F.col("_there").isNull(), "missing")
        .when(~F.coalesce("_valid", F.lit(False)), "invalid_vector")
        .when(~same("_of_", "_now_", inputs), "stale")
    )
    usable = F.coalesce("usable", F.lit(False))
    state = (
        F.when(~usable, "invalid_input")
        .when(upstream.isNotNull(), "dependency_missing")
        .when(~same("", "_now_", inputs) | ~same("", "_of_", recorded), "stale")
        .otherwise("ready")
    )
    return found.select("result_id", state.alias("coverage"), F.when(usable, upstream).alias("upstream"))


def plan_actions(covered: DataFrame) -> DataFrame:
    """``covered`` with what a run does: reuse what is ready, skip what can't be an input, compute the rest."""
    action = F.when(F.col("coverage") == "ready", "reuse").when(F.col("coverage").isin("invalid_input", "dependency_missing"), "skip").otherwise("compute")
    return covered.withColumn("action", action)


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` over ``old``: rows of a key that is in both come from ``new``."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, with their numbers."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def reachable(edges: DataFrame, start: DataFrame, most_steps: int = 1000) -> DataFrame:
    """(start, node, steps): what each start reaches along ``edges`` (source, target), with the least number of steps.

    A start that reaches itself lies on a cycle. Only new pairs go on, so cycles end; more than ``most_steps`` are an error.
    """
    first = start.select(F.col("node").alias("start")).distinct().join(edges, F.col("start") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
    fronts = [cut(first.withColumn("steps", F.lit(1)))]
    while not fronts[-1].isEmpty():
        if len(fronts) >= most_steps:
            raise ValueError(f"more than {most_steps} steps")
        new = fronts[-1].join(edges, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, fronts).select("start", "node")  # kept rows, each written once
        fronts.append(cut(new.join(seen, ["start", "node"], "left_anti").withColumn("steps", F.lit(len(fronts) + 1))))
    return reduce(DataFrame.unionByName, fronts)
