"""Exact and near duplicates by content hash and by 64-bit fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.operators.components import connected_components
from gleanframe.session import cut


def exact_classes(items: DataFrame, key: str, content: str) -> DataFrame:
    """(key, class_id, copies): each item with the least key of the items of its content, and their number.

    Items without a content are left out. A class of any size is counted map-side; copies aren't expanded into pairs.
    """
    known = items.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(key, content).distinct()
    classes = known.groupBy(content).agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return known.join(classes, content).select(key, "class_id", "copies")


def exact_groups(items: DataFrame, key: str, content: str) -> DataFrame:
    """(content, class_id, members, exact_pairs) of contents that several items share."""
    known = items.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(key, content).distinct()
    n = F.count(F.lit(1))
    return known.groupBy(content).agg(F.min(key).alias("class_id"), n.alias("members")).where("members > 1").withColumn(
        "exact_pairs", F.expr("members * (members - 1) div 2")
    )


def sign_bits(vector: str) -> Column:
    """A 64-bit fingerprint of a vector of 64 numbers: bit i from the left is set where element i is positive."""
    bit = F.transform(F.col(vector), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (63 - i).cast("int"))).otherwise(0))
    return F.aggregate(bit, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def hash_from_hex(text: str) -> Column:
    """The fingerprint in 16 lower-case hexadecimal digits; NULL for anything else."""
    return F.when(F.col(text).rlike("\\A[0-9a-f]{16}\\z"), F.conv(F.col(text), 16, -10).cast("bigint"))


#: Up to this distance bands of 5 bits or more bring together less than a third of all pairs.
BANDED = 11

#: Fingerprints of a block; two blocks are compared at once.
BLOCK = 4096


def _every_two(rows: DataFrame, distance: int) -> DataFrame:
    rows = cut(rows)
    blocks = max(1, -(-rows.count() // BLOCK))
    at = rows.withColumn("at", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    at = at.select("k", "h", "at", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"))
    a, b = at.alias("a"), at.alias("b")
    once = (F.col("a.k") < F.col("b.k")) & ((F.col("a.at") != F.col("b.at")) | (F.col("a.low") == F.col("a.high")))
    apart = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))).cast("int")
    same = (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
    return a.join(b, same & once & (apart <= distance)).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), apart.alias("distance"))


def hamming_links(classes: DataFrame, key: str, bits: str, distance: int) -> DataFrame:
    """(a, b, distance), a < b: pairs of fingerprints that differ in up to ``distance`` bits.

    Fingerprints are cut into ``distance`` + 1 bands: two within the distance agree in one of them. A pair comes from the
    first band in which it agrees, so none comes twice. Bands of few bits, for distances above ``BANDED``, agree by chance more often
    than there are pairs; then every two are compared, block by block. Give one row a fingerprint; equal ones link at 0.
    """
    if distance > BANDED:
        return _every_two(classes.where(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("h")), distance)
    bands = distance + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    pieces = [
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft(F.col(bits), lo), 64 - (hi - lo)).alias("piece"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    rows = classes.where(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("h"), F.inline(F.array(*pieces)))
    a, b = rows.alias("a"), rows.alias("b")
    changed = F.col("a.h").bitwiseXOR(F.col("b.h"))
    earlier = F.lit(False)  # whether an earlier band agrees
    for i, (lo, hi) in enumerate(zip(edges[:-2], edges[1:-1])):
        agrees = F.shiftrightunsigned(F.shiftleft(changed, lo), 64 - (hi - lo)) == 0
        earlier = earlier | ((F.col("a.band") > i) & agrees)
    return (
        a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.k") < F.col("b.k")))
        .where((F.bit_count(changed) <= distance) & ~earlier)
        .select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.bit_count(changed).cast("int").alias("distance"))
    )


def _stars(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every 64 batches of edges (u, v) each of their vertices with the least one that it is connected with there."""
    for batches in batched(stream, 64):
        edges = pa.Table.from_batches(batches)
        if not edges.num_rows:
            continue
        coded = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks]).combine_chunks().dictionary_encode()
        names = np.asarray(coded.dictionary.to_pylist(), object)
        order = np.argsort(names)
        names, place = names[order], np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        at = place[coded.indices.to_numpy()]
        u, v = at[: edges.num_rows], at[edges.num_rows :]
        label = np.arange(len(names))
        while True:
            least = np.minimum(label[u], label[v])
            low = label.copy()
            for end in (u, v, label[u], label[v]):
                np.minimum.at(low, end, least)
            low = low[low]
            if (low == label).all():
                break
            label = low
        away = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[label[away]], pa.string()), pa.array(names[away], pa.string())], ["u", "v"])


def star_edges(links: DataFrame) -> DataFrame:
    """(u, v) that connect what ``links`` (a, b: strings) connect. Many links of few items are reduced to stars where they
    arise, so that they aren't kept."""
    edges = links.where("a is not null and b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return edges.mapInArrow(_stars, "u string, v string")


def linked_labels(links: DataFrame) -> DataFrame:
    """(v, label) as connected_components gives it of ``links`` (a, b: strings), by way of ``star_edges``."""
    return connected_components(star_edges(links))


def duplicate_groups(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(group_id, members, links, least_distance, kind) of linked items; membership is not similarity of every two.

    ``labels``: the items' components, if they are known.
    """
    if labels is None:
        labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    edges = links.join(labels, links["a"] == labels["v"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("links"), F.min("distance").alias("least_distance"), F.max("distance").alias("greatest")
    )
    kind = F.when(F.col("greatest") == 0, "exact").when(F.col("least_distance") == 0, "mixed").otherwise("similar")
    return members.join(edges, "label").select(F.col("label").alias("group_id"), "members", "links", "least_distance", kind.alias("kind"))


def peer_summary(links: DataFrame) -> DataFrame:
    """(item, peers, least_distance, best_peer): of the peers at the least distance the first by id."""
    ways = links.select(F.inline(F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("peer"), "distance"), F.struct(F.col("b").alias("item"), F.col("a").alias("peer"), "distance"))))
    best = F.min(F.struct("distance", "peer"))
    return ways.groupBy("item").agg(F.count(F.lit(1)).alias("peers"), best.alias("best")).select(
        "item", "peers", F.col("best.distance").alias("least_distance"), F.col("best.peer").alias("best_peer")
    )


def copy_links(classes: DataFrame, distance: int) -> DataFrame:
    """(a, copies_a, b, copies_b, distance) of classes (class_id, copies, bits): hamming_links that carry the classes' sizes, so
    that the links, of which there are many, needn't be joined with them."""
    keyed = classes.select(F.struct("class_id", "copies").alias("k"), "bits").where("class_id is not null")
    ends = [F.col(f"{end}.{name}").alias(alias) for end in "ab" for name, alias in (("class_id", end), ("copies", f"copies_{end}"))]
    return hamming_links(keyed, "k", "bits", distance).select(*ends, "distance")


def copy_labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class_id, copies, label) of the classes that are linked or have several members; ``classes``: (class_id, copies)."""
    labels = linked_labels(links).select(F.col("v").alias("class_id"), "label")
    known = classes.join(labels, "class_id", "left").where("label is not null or copies > 1")
    return known.select("class_id", "copies", F.coalesce("label", "class_id").alias("label"))


def copy_groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(group_id, members, exact_pairs, similar_pairs, least_distance, kind) of the members of linked or repeated classes.

    ``classes``: (class_id, copies), ``links``: as copy_links gives them. Copies are counted, not expanded
    into pairs. ``least_distance`` is that of similar pairs, NULL where there are none.
    """
    placed = cut(copy_labels(classes, links))
    members = placed.groupBy("label").agg(F.sum("copies").alias("members"), F.sum(F.expr("copies * (copies - 1) div 2")).alias("exact_pairs"))
    sizes = links.groupBy("a").agg(F.sum(F.col("copies_a") * F.col("copies_b")).alias("pairs"), F.min("distance").alias("least"))
    similar = sizes.join(placed, F.col("a") == F.col("class_id")).groupBy("label").agg(F.sum("pairs").alias("similar_pairs"), F.min("least").alias("least_distance"))
    found = members.join(similar, "label", "left").withColumn("similar_pairs", F.coalesce("similar_pairs", F.lit(0).cast("bigint")))
    kind = F.when(F.col("similar_pairs") == 0, "exact").when(F.col("exact_pairs") > 0, "mixed").otherwise("similar")
    return found.select(F.col("label").alias("group_id"), "members", "exact_pairs", "similar_pairs", "least_distance", kind.alias("kind"))


def copy_peers(members: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(item, exact_peers, similar_peers, least_distance, best_peer) of ``members`` (key, class_id, copies) with a peer.

    ``links``: as copy_links gives them. The best peer is the first other copy, else the first of those at the least distance: a class's id is its first member.
    """
    classes = members.groupBy("class_id").agg(F.first("copies").alias("copies"), F.min(F.when(F.col(key) != F.col("class_id"), F.col(key))).alias("second"))
    ways = links.select(F.inline(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("peer"), F.col("copies_b").alias("peer_copies"), "distance"), F.struct(F.col("b").alias("class_id"), F.col("a").alias("peer"), F.col("copies_a").alias("peer_copies"), "distance"))))
    near = ways.groupBy("class_id").agg(F.sum("peer_copies").alias("similar_peers"), F.min(F.struct("distance", "peer")).alias("best"))
    of = classes.join(near, "class_id", "left").where("copies > 1 or best is not null")
    own = F.when(F.col(key) == F.col("class_id"), F.col("second")).otherwise(F.col("class_id"))
    return members.select(key, "class_id").join(of, "class_id").select(
        F.col(key).alias("item"), (F.col("copies") - 1).alias("exact_peers"), F.coalesce("similar_peers", F.lit(0).cast("bigint")).alias("similar_peers"),
        F.when(F.col("copies") > 1, 0).otherwise(F.col("best.distance")).alias("least_distance"), F.when(F.col("copies") > 1, own).otherwise(F.col("best.peer")).alias("best_peer"),
    )
