"""Combining cells of several conditions: eligibility, order of candidates, and ranks by matched pattern.

``cells``: (item, condition_id, status, raw_score), one row for each item and condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.operators.ordering import average_rank_percentile, numbered

SUPPORT = ("matched", "eligible")


def supported(cells: DataFrame, operator: str) -> DataFrame:
    """(item) that all (and) or any (or) of the conditions support. Unknown cells support nothing."""
    supports = F.coalesce(F.col("status").isin(*SUPPORT), F.lit(False))
    test = F.bool_and(supports) if operator == "and" else F.bool_or(supports)
    return cells.groupBy("item").agg(test.alias("_ok")).where("_ok").select("item")


def candidates(cells: DataFrame, semantic: list[str], operator: str, limit: int | None = None) -> DataFrame:
    """(number, item): supported items, queue after queue of the semantic conditions, then by id.

    An item stands in the first queue, in the order of ``semantic``, in which it is eligible, by its score there. With a
    limit only so many rows are sorted.
    """
    pool = cells.join(supported(cells, operator), "item", "left_semi")
    queue = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(semantic))):
        queue = F.when((F.col("condition_id") == c) & (F.col("status") == "eligible"), F.lit(i)).otherwise(queue)
    first = pool.withColumn("_q", queue).groupBy("item").agg(
        F.min(F.when(F.col("_q").isNotNull(), F.struct("_q", (-F.col("raw_score")).alias("minus")))).alias("first")
    )
    order = [F.coalesce("first._q", F.lit(len(semantic))), F.coalesce("first.minus", F.lit(0.0)), F.col("item")]
    if limit is None:
        return numbered(first, order).select("number", "item")
    top = first.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("number"), "item")  # over ``limit`` rows


def status_counts(cells: DataFrame) -> DataFrame:
    """(condition_id, status, items)."""
    return cells.groupBy("condition_id", "status").agg(F.count(F.lit(1)).alias("items"))


def condition_pool(cells: DataFrame, semantic_candidates: int = 10) -> DataFrame:
    """(item) of the union of structured matches and of each semantic condition's best candidates."""
    best = Window.partitionBy("condition_id").orderBy(F.col("raw_score").desc(), "item")
    near = cells.where("status = 'eligible'").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= semantic_candidates)
    return cells.where("status = 'matched'").select("item").unionByName(near.select("item")).distinct()


def pool_cells(cells: DataFrame, semantic_candidates: int = 10) -> DataFrame:
    """The cells of all conditions for the items of ``condition_pool``: an item that one condition brings is scored by every one."""
    return cells.join(condition_pool(cells, semantic_candidates), "item", "left_semi")


def pattern_scores(cells: DataFrame) -> DataFrame:
    """(item, matched_ids, matched_count, pattern_score) of items with a match: the mean normalized score of their matches."""
    matched = cells.where("status = 'matched'").select("item", "condition_id", "raw_score")
    normalized = average_rank_percentile(matched, "condition_id", "item", "raw_score")
    return normalized.groupBy("item").agg(
        F.array_join(F.sort_array(F.collect_set("condition_id")), ",").alias("matched_ids"),
        F.count(F.lit(1)).alias("matched_count"),
        F.avg("normalized").alias("pattern_score"),
    )


def interleaved(scores: DataFrame, seed: str, slot_key: Column | None = None) -> DataFrame:
    """(result_rank, item, …): items by matched count, patterns of one count mixed by a seeded shuffle of their slots.

    Each pattern has a slot for each of its items; slots are ordered by a hash of seed, pattern and number, and a pattern's
    k-th slot in that order takes its k-th item by score, so the order within a pattern stays.
    """
    by_score = numbered(scores, [F.col("matched_ids"), F.col("pattern_score").desc(), F.col("item")], "_n")
    start = by_score.groupBy("matched_ids").agg(F.min("_n").alias("_start"))
    placed = by_score.join(start, "matched_ids").withColumn("_k", F.col("_n") - F.col("_start"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), "matched_ids", F.col("_k").cast("string"))) if slot_key is None else slot_key
    slots = numbered(placed.select("matched_ids", "matched_count", "_k", draw.alias("_draw")), [F.col("matched_ids"), F.col("_draw"), F.col("_k")], "_m")
    first = slots.groupBy("matched_ids").agg(F.min("_m").alias("_first"))
    order = slots.join(first, "matched_ids").select("matched_ids", "_draw", (F.col("_m") - F.col("_first")).alias("_k"))
    filled = placed.drop("_n", "_start").join(order, ["matched_ids", "_k"])
    ranked = numbered(filled, [F.col("matched_count").desc(), F.col("_draw"), F.col("matched_ids"), F.col("_k")], "result_rank")
    return ranked.select("result_rank", "item", "matched_ids", "matched_count", "pattern_score")


def retrieval_counts(cells: DataFrame, chosen: DataFrame, semantic: list[str]) -> DataFrame:
    """(condition_id, eligible, ineligible, unretrieved) of semantic conditions: items that could be ranked, couldn't, and
    could but aren't among ``chosen`` (item)."""
    marked = cells.where(F.col("condition_id").isin(semantic)).join(chosen.select("item", F.lit(1).alias("_in")).distinct(), "item", "left")
    eligible = F.col("status") == "eligible"
    return marked.groupBy("condition_id").agg(
        F.count_if(eligible).alias("eligible"), F.count_if(~eligible).alias("ineligible"), F.count_if(eligible & F.col("_in").isNull()).alias("unretrieved")
    )


def with_evidence(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates with the cells of further conditions, which neither filter nor rank."""
    return ranked.join(evidence, "item", "left")
