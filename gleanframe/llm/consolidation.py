"""Consolidating pairwise matches into groups.

Rounds of two reductions shrink the graph of matches: vertices of degree one are stripped, and chains of vertices of
degree two are ranked by pointer jumping over their directed arcs and replaced by one edge between their ends. What
remains, the core, is solved by star contraction; removed vertices then take the labels of those they hung on, last removed
first. Rounds go on while one takes away a fair part of the edges; a deep tree's rest is left to the core, which solves any graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.operators.components import both_ways, connected_components
from gleanframe.operators.ordering import numbered
from gleanframe.session import counted, cut


def _low_degree(edges: DataFrame) -> DataFrame:
    """Vertices of degree one and two with their least and greatest neighbour."""
    return (
        both_ways(edges)
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("a"), F.max("n").alias("b"))
        .where("d <= 2")
    )


def _strip(edges: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without those of ``leaves``, and (v, parent) of each leaf. Of a lone edge the greater end is the leaf.

    A leaf names its one edge, so edges are removed by both ends: no join meets a hub's key.
    """
    gone = (
        leaves.select(F.least("v", "a").alias("u"), F.greatest("v", "a").alias("w"), "v")
        .groupBy("u", "w")
        .agg(F.max("v").alias("leaf"))
    )
    removed = gone.select(F.col("leaf").alias("v"), F.when(F.col("leaf") == F.col("w"), F.col("u")).otherwise(F.col("w")).alias("parent"))
    left = edges.join(gone.select("u", F.col("w").alias("v")), ["u", "v"], "left_anti")
    return left, removed


def _jump(arcs: DataFrame) -> DataFrame:
    """Each active arc takes over what the arc at which it has arrived has reached."""
    ahead = arcs.select(
        F.col("v").alias("end"), F.col("back").alias("previous"), F.col("end").alias("end2"), F.col("previous").alias("previous2"), F.col("low").alias("low2"), F.col("active").alias("active2")
    )
    moved = arcs.where("active").join(ahead, ["end", "previous"], "left").select(
        "v",
        "back",
        F.coalesce("end2", "end").alias("end"),
        F.coalesce("previous2", "previous").alias("previous"),
        F.least("low", "low2").alias("low"),
        F.coalesce("active2", F.lit(False)).alias("active"),
    )
    return moved.unionByName(arcs.where("not active"))


def rank_chains(chain: DataFrame) -> DataFrame:
    """Where the chains of ``chain`` (v, a, b: vertices of degree two) end, by pointer jumping.

    Each vertex has two arcs, one per direction; an arc points at the vertex it has reached and where it came from, and in
    each step takes over what that arc has reached, so a chain of n vertices needs log2 n steps, two to a round. Returns one row an arc:
    (v, back, end, low, active); ``active`` arcs run in a circle, of which ``low`` is the least vertex.
    """
    arcs = chain.select(
        F.inline(
            F.array(
                F.struct("v", F.col("a").alias("back"), F.col("b").alias("end"), F.col("v").alias("previous")),
                F.struct("v", F.col("b").alias("back"), F.col("a").alias("end"), F.col("v").alias("previous")),
            )
        )
    )
    arcs = arcs.select("v", "back", "end", "previous", F.col("v").alias("low"), F.lit(True).alias("active"))
    active = F.col("active")
    measures = {"active": F.count_if(active), "sum": F.sum(F.when(active, F.col("low")).cast("decimal(38,0)"))}
    arcs, before = counted(_jump(arcs), **measures)
    while before["active"]:
        arcs, now = counted(_jump(_jump(arcs)), **measures)
        if now == before:
            break
        before = now
    return arcs


def _compress(edges: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with each chain of ``chain`` as one edge between its ends, and (v, parent) of each vertex taken out."""
    arcs = rank_chains(chain)
    ends = arcs.groupBy("v").agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("low").alias("low"), F.bool_or("active").alias("circle"))
    removed = ends.select("v", F.when(F.col("circle"), F.col("low")).otherwise(F.col("e1")).alias("parent")).where("v <> parent")
    touched = chain.select(F.inline(F.array(F.struct("v", F.col("a").alias("n")), F.struct("v", F.col("b").alias("n"))))).select(
        F.least("v", "n").alias("u"), F.greatest("v", "n").alias("v")
    )
    bridges = ends.where("not circle and e1 <> e2").select(F.col("e1").alias("u"), F.col("e2").alias("v"))
    left = edges.join(touched, ["u", "v"], "left_anti").unionByName(bridges).distinct()
    return left, removed


#: A round that leaves more than this part of the edges is the last.
WORTH = 0.9


def component_labels(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (u < v, bigint, distinct); vertices of one component share a label."""
    removed: list[DataFrame] = []
    rows = F.count(F.lit(1))
    degrees = {"leaves": F.count_if(F.col("d") == 1), "inner": F.count_if(F.col("d") == 2)}
    edges, n = counted(edges, rows=rows)
    while n["rows"]:
        before = n["rows"]
        low, found = counted(_low_degree(edges), **degrees)
        if found["leaves"]:
            edges, leaves = _strip(edges, low.where("d = 1"))
            edges, n = counted(edges, rows=rows)
            removed.append(leaves)  # a small aggregate of kept rows, like the chains' below
            low, found = counted(_low_degree(edges), **degrees)
        if found["inner"]:
            edges, inner = _compress(edges, low.where("d = 2"))
            edges, n = counted(edges, rows=rows)
            removed.append(inner)
        if n["rows"] > WORTH * before:
            break
    labels = connected_components(edges)
    for part in reversed(removed):
        restored = part.join(labels.withColumnRenamed("v", "parent"), "parent", "left").select(
            "v", "parent", "label"
        )
        # A parent without a label yet is the root of its group and labels itself.
        roots = restored.where("label is null").select(F.col("parent").alias("v"), F.col("parent").alias("label")).distinct()
        labels = cut(
            reduce(
                DataFrame.unionByName,
                [labels, restored.select("v", F.coalesce("label", "parent").alias("label")), roots],
            )
        )
    return labels


def vertex(column: str) -> Column:
    return F.xxhash64(column)


def consolidate(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group_id) for each id of ``links``; group_id is the least id linked to it directly or through others.

    ``a`` and ``b`` are string columns. A link of an id with itself or with NULL is left out, repeated links and links the
    other way round count once, an empty table gives no rows, other columns are ignored. Vertices are 64-bit hashes under a
    seed for which the ids of this table have no collision, checked over all of them.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("v", vertex("id"))
    names, n = counted(names, ids=F.count(F.lit(1)))
    if names.agg(F.count_distinct("v")).first()[0] == n["ids"]:
        coded = pairs.select(vertex("a").alias("x"), vertex("b").alias("y"))
    else:
        # Two ids have one hash, as is likely beyond some 10⁹ of them: they are numbered, and the links joined with the numbers.
        names = cut(numbered(names.select("id"), [F.col("id")], "v"))
        first, second = names.select(F.col("id").alias("a"), F.col("v").alias("x")), names.select(F.col("id").alias("b"), F.col("v").alias("y"))
        coded = pairs.join(first, "a").join(second, "b")
    edges = coded.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    labels = component_labels(edges).join(names, "v").select("id", "label")
    groups = labels.groupBy("label").agg(F.min("id").alias("group_id"))
    return labels.join(groups, "label").select("id", "group_id")


def group_sizes(groups: DataFrame) -> DataFrame:
    """(group_id, members) of ``consolidate``'s result."""
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
