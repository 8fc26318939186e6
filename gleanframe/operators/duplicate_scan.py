"""A scan for duplicates as one result: exact ones by content, similar ones by fingerprint, in groups and item by item.

Items of one content are exact duplicates of each other. Items of different contents whose fingerprints differ in up to a
number of bits, none included, are similar. Items are reduced to *cells*, one for each content and fingerprint with its number
of items, so copies are counted and never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.operators.components import connected_components
from gleanframe.operators.duplicates import hamming_links, star_edges
from gleanframe.operators.ordering import numbered
from gleanframe.session import cut


@dataclass(frozen=True)
class Cells:
    """``items``: (item, content, bits); an item without a content has one of its own. ``cells``: (content, bits, n, first, number, of), ``number``
    being the place of the cell's first item among those of all cells and ``of`` that of its content's. ``contents``: (content, items, first,
    second). ``prints``: (bits, items, one, two): the first item of a fingerprint and the first of another content, each as (number, of).
    ``shared``: (content, a, b, na, nb): pairs of near fingerprints within a content. ``names``: (number, first)."""

    items: DataFrame
    cells: DataFrame
    contents: DataFrame
    prints: DataFrame
    shared: DataFrame
    names: DataFrame
    distance: int


def cells_of_items(items: DataFrame, item: str, content: str, bits: str, distance: int) -> Cells:
    """``items``: one row an item; NULL contents can't be exact duplicates, NULL fingerprints can't be similar ones. Rows
    without an item are left out."""
    known = cut(
        items.where(F.col(item).isNotNull()).select(
            F.col(item).alias("item"),
            F.coalesce(F.concat(F.lit("c:"), F.col(content)), F.concat(F.lit("i:"), F.col(item))).alias("content"),
            F.col(bits).alias("bits"),
        )
    )
    n = F.count(F.lit(1))
    plain = cut(known.groupBy("content", "bits").agg(n.alias("n"), F.min("item").alias("first")))
    least = plain.groupBy("content").agg(F.sum("n").alias("items"), F.min("first").alias("first"))
    second = known.join(least, "content").where(F.col("item") != F.col("first")).groupBy("content").agg(F.min("item").alias("second"))
    contents = cut(least.join(second, "content", "left"))
    # An item is in one cell, so the first items of cells are told apart by their numbers, which are smaller than names.
    names = cut(numbered(plain.select("first"), [F.col("first")]))
    of = contents.select("content", "first").join(names, "first").select("content", F.col("number").alias("of"))
    cells = cut(plain.join(names, "first").join(of, "content"))
    printed = cells.where("bits is not null")
    one = printed.groupBy("bits").agg(F.sum("n").alias("items"), F.min(F.struct("number", "of")).alias("one"))
    two = printed.join(one, "bits").where(F.col("of") != F.col("one.of")).groupBy("bits").agg(F.min(F.struct("number", "of")).alias("two"))
    prints = cut(one.join(two, "bits", "left"))
    several = printed.join(printed.groupBy("content").agg(n.alias("k")).where("k > 1"), "content", "left_semi").select("content", "bits", "n")
    a, b = several.alias("a"), several.alias("b")
    near = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= distance
    shared = cut(
        a.join(b, (F.col("a.content") == F.col("b.content")) & (F.col("a.bits") < F.col("b.bits")) & near).select(
            F.col("a.content").alias("content"), F.col("a.bits").alias("a"), F.col("b.bits").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")
        )
    )
    return Cells(known, cells, contents, prints, shared, names, distance)


_CANDIDATE = "bits bigint, items bigint, distance int, number bigint, of bigint"


def _best_two(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every 64 batches of candidates each fingerprint's first one and its first of another content; items are added up."""
    for batches in batched(stream, 64):
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            continue
        bits, items, distance, number, of = (table[i].to_numpy() for i in range(5))
        order = np.lexsort((number, distance, bits))
        bits, items, distance, number, of = bits[order], items[order], distance[order], number[order], of[order]
        who, first = np.unique(bits, return_index=True)
        group = np.repeat(np.arange(len(who)), np.diff([*first, len(bits)]))
        total = np.add.reduceat(items, first)
        other = np.flatnonzero(of != of[first][group])
        apart, at = np.unique(group[other], return_index=True)
        second = other[at]
        rows = np.concatenate([first, second])
        sums = np.concatenate([total, np.zeros(len(second), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(bits[rows]), pa.array(sums), pa.array(distance[rows]), pa.array(number[rows]), pa.array(of[rows])], ["bits", "items", "distance", "number", "of"])


def _around(c: Cells) -> DataFrame:
    """(bits, items, distance, number, of): for each fingerprint the first items, and the first ones of other contents, of those
    around it, itself included, and how many items these have. The links carry all this and are reduced where they arise, as there
    are many more of them than fingerprints."""
    links = hamming_links(c.prints.select(F.struct("bits", "items", "one", "two").alias("k"), "bits"), "k", "bits", c.distance)
    way = lambda of, to: F.struct(F.col(f"{of}.bits").alias("bits"), F.col(to).alias("to"), "distance")
    every = links.select(F.inline(F.array(way("a", "b"), way("b", "a")))).unionByName(c.prints.select("bits", F.struct("bits", "items", "one", "two").alias("to"), F.lit(0).alias("distance")))
    candidate = lambda which, items: F.struct(items.alias("items"), "distance", F.col(f"to.{which}.number").alias("number"), F.col(f"to.{which}.of").alias("of"))
    both = every.select("bits", F.inline(F.array(candidate("one", F.col("to.items")), candidate("two", F.lit(0).cast("bigint")))))
    return cut(both.where("number is not null").mapInArrow(_best_two, _CANDIDATE))


def _near(c: Cells) -> DataFrame:
    """(content, bits, n, similar, distance, peer) of the cells: items of other contents within the distance, the least distance
    and the first item there."""
    around = _around(c)
    place = F.struct("distance", "number", "of")
    first = cut(around.groupBy("bits").agg(F.sum("items").alias("items"), F.min(place).alias("x")))
    second = around.join(first.select("bits", F.col("x.of").alias("taken")), "bits").where("of <> taken").groupBy("bits").agg(F.min(place).alias("y"))
    both = first.join(second, "bits", "left")
    own = c.shared.select(F.inline(F.array(F.struct("content", F.col("a").alias("bits"), F.col("nb").alias("same")), F.struct("content", F.col("b").alias("bits"), F.col("na").alias("same")))))
    own = own.groupBy("content", "bits").agg(F.sum("same").alias("same"))
    best = F.when(F.col("x.of") != F.col("of"), F.col("x")).otherwise(F.col("y"))
    found = c.cells.where("bits is not null").join(both, "bits").join(own, ["content", "bits"], "left").withColumn("best", best)
    similar = F.col("items") - F.col("n") - F.coalesce("same", F.lit(0))
    counted = found.select("content", "bits", "n", similar.alias("similar"), F.col("best.distance").alias("distance"), F.col("best.number").alias("number")).where("similar > 0")
    return counted.join(c.names.withColumnRenamed("first", "peer"), "number").drop("number")


def item_matches(c: Cells) -> DataFrame:
    """(item, exact_peers, similar_peers, min_distance, metric, best_distance, best_match) of each item with a peer. An exact
    peer is the best match, the first one; else the first at the least distance."""
    rows = c.items.join(c.contents, "content").join(_near(c).drop("n"), ["content", "bits"], "left")
    exact = F.col("items") > 1
    found = rows.where(exact | F.col("similar").isNotNull())
    return found.select(
        "item",
        (F.col("items") - 1).alias("exact_peers"),
        F.coalesce("similar", F.lit(0).cast("bigint")).alias("similar_peers"),
        F.col("distance").alias("min_distance"),
        F.when(exact, "exact").otherwise("hamming").alias("metric"),
        F.when(exact, 0).otherwise(F.col("distance")).alias("best_distance"),
        F.when(exact, F.when(F.col("item") == F.col("first"), F.col("second")).otherwise(F.col("first"))).otherwise(F.col("peer")).alias("best_match"),
    )


def item_labels(c: Cells) -> DataFrame:
    """(content, bits, label): the component of each cell, over contents and fingerprints as vertices."""
    print_of = lambda name: F.concat(F.lit("h:"), F.col(name).cast("string"))
    links = hamming_links(c.prints.select("bits", F.col("bits").alias("h")), "bits", "h", c.distance)
    edges = c.cells.where("bits is not null").select(F.col("content").alias("u"), print_of("bits").alias("v")).unionByName(star_edges(links.select(print_of("a").alias("a"), print_of("b").alias("b"))))
    labels = connected_components(edges)
    return c.cells.join(labels, c.cells["content"] == labels["v"], "left").select("content", "bits", F.coalesce("label", "content").alias("label"))


def scan_groups(c: Cells) -> DataFrame:
    """(number, group_id, kind, members, exact_pairs, similar_pairs, min_distance) of groups of items with a peer.

    group_id is a group's first item; a group is a component, not a set of which every two match. Numbers go by: exact groups
    first, least distance, most members, first item.
    """
    labels = cut(item_labels(c))
    placed = c.cells.join(labels.withColumnRenamed("bits", "b"), (c.cells["content"] == labels["content"]) & c.cells["bits"].eqNullSafe(F.col("b"))).select(c.cells["content"], c.cells["bits"], "n", "first", "label")
    members = placed.groupBy("label").agg(F.sum("n").alias("members"), F.min("first").alias("group_id"))
    one = labels.groupBy("content").agg(F.first("label").alias("label"))
    exact = c.contents.join(one, "content").groupBy("label").agg(F.sum(F.expr("items * (items - 1) div 2")).alias("exact_pairs"))
    similar = _near(c).join(labels, ["content", "bits"]).groupBy("label").agg(F.expr("sum(n * similar) div 2").alias("similar_pairs"), F.min("distance").alias("min_distance"))
    found = members.join(exact, "label").join(similar, "label", "left").withColumn("similar_pairs", F.coalesce("similar_pairs", F.lit(0).cast("bigint"))).where("exact_pairs > 0 or similar_pairs > 0")
    kind = F.when(F.col("similar_pairs") == 0, "exact").when(F.col("exact_pairs") > 0, "mixed").otherwise("similar")
    groups = found.select("group_id", kind.alias("kind"), "members", "exact_pairs", "similar_pairs", "min_distance")
    order = [(F.col("kind") != "exact"), F.coalesce("min_distance", F.lit(-1)), -F.col("members"), F.col("group_id")]
    return numbered(groups, order)
