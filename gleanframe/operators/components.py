"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.operators.skew import AT_ONCE, heaviest, salted_join
from gleanframe.session import counted


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) from either end, as (v, n)."""
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("n")), F.struct(F.col("v").alias("v"), F.col("u").alias("n")))))


def _low(pairs: DataFrame) -> DataFrame:
    """(v, least, rows) of each v of (v, n): its least n, taken map-side, and its number of rows."""
    return pairs.groupBy("v").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows"))


def _with_low(pairs: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (v, n) with their v's ``least``. The rows of a hub are divided; the check for hubs costs nothing where there
    are fewer rows than one task joins."""
    if rows <= AT_ONCE:
        return pairs.join(low.select("v", "least"), "v")
    return salted_join(pairs, low.select("v", "least"), ["v"], heaviest(low, ["v"], "rows"), F.col("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (u, v of one orderable type); the label is the component's least vertex.

    Loops and repeated edges do no harm, rows with a NULL end are left out, an empty table gives no rows. Logarithmically
    many rounds in practice; each round is one job and leaves a reliable checkpoint.
    """
    measures = {"edges": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e = edges.where("u is not null and v is not null and u <> v")
    e, before = counted(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), **measures)
    while before["edges"]:
        pairs = both_ways(e)
        large = (
            _with_low(pairs, _low(pairs), 2 * before["edges"])
            .select("v", "n", F.least("least", "v").alias("m"))
            .where("n > v and n <> m")
            .select(F.col("n").alias("v"), F.col("m").alias("n"))
            .distinct()
        )
        small = (
            _with_low(large, _low(large), before["edges"])
            .select(F.inline(F.array(F.struct(F.col("least").alias("u"), F.col("n").alias("v")), F.struct(F.col("least").alias("u"), F.col("v").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        e, now = counted(small, **measures)
        if now == before:
            break
        before = now
    return e.select("v", F.col("u").alias("label")).unionByName(e.select(F.col("u").alias("v"), F.col("u").alias("label")).distinct())
