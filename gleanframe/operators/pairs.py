"""Pages of the pairs within groups, without listing the pairs before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.operators.ordering import numbered, running_total


def pair_page(members: DataFrame, group: str, item: str, after: int, size: int) -> DataFrame:
    """(pair_no, group, a, b): pairs ``after`` + 1 to ``after`` + ``size``, a < b, in the order of group, a and b.

    ``members``: distinct (group, item). The i-th of n members opens n − i pairs, so running totals say which members' pairs
    are on the page; only their partners are looked up.
    """
    rows = members.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null")
    placed = numbered(rows, [F.col("g"), F.col("i")], "_n")
    spans = placed.groupBy("g").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_count"))
    known = placed.join(spans, "g").select("g", "i", (F.col("_n") - F.col("_first")).alias("at"), "_count").withColumn("opens", F.col("_count") - 1 - F.col("at"))
    counted = running_total(known, [F.col("g"), F.col("i")], "opens")
    first, last = F.greatest(F.col("before"), F.lit(after)), F.least(F.col("before") + F.col("opens"), F.lit(after + size))
    here = counted.where((F.col("opens") > 0) & (first < last)).select(
        "g", "i", "at", "before", F.explode(F.sequence(first, last - 1)).alias("pair")
    )
    partner = here.withColumn("other", F.col("at") + 1 + F.col("pair") - F.col("before"))
    others = counted.select("g", F.col("i").alias("b"), F.col("at").alias("other"))
    return partner.join(others, ["g", "other"]).select((F.col("pair") + 1).alias("pair_no"), F.col("g").alias(group), F.col("i").alias("a"), "b")


def exact_subgroups(labels: DataFrame, content: DataFrame, item: str, version: str) -> DataFrame:
    """(label, content, members) of the contents that several items of one component share."""
    joined = labels.join(content.select(F.col(item).alias("v"), F.col(version).alias("content")), "v").where("content is not null")
    return joined.groupBy("label", "content").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def group_digest(labels: DataFrame, parameters: str) -> DataFrame:
    """(label, digest) that depends on a component's members and the parameters only.

    Members are digested in slices of their sorted order and the slices' digests together, so no group is gathered whole.
    """
    slices = 1024
    sliced = labels.withColumn("slice", F.pmod(F.xxhash64("v"), F.lit(slices)))
    parts = sliced.groupBy("label", "slice").agg(
        F.sum(F.xxhash64(F.lit("1"), "v").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit("2"), "v").cast("decimal(38,0)")).alias("s2"), F.count(F.lit(1)).alias("n")
    )
    text = F.concat_ws(":", "slice", F.col("s1").cast("string"), F.col("s2").cast("string"), "n")
    return parts.groupBy("label").agg(F.sha2(F.concat_ws("|", F.lit(parameters), F.array_join(F.sort_array(F.collect_list(text)), "|")), 256).alias("digest"))
