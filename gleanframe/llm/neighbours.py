"""The most similar vectors for every vector, over balanced posting lists.

Centres are learnt by balanced k-means in two levels: groups from a bounded sample on the driver, then each group's centres from
a sample of its own vectors, group by group on the workers, so lists grow in number with the vectors. Centres are kept apart from
each other, so that a dense mass is one list. A search graph over the groups, small enough for every worker's memory, leads a
vector to its group; the group's own graph, over its centres and those of other groups near its boundary, finds its lists. Every
vector is posted to its nearest centre and, near a boundary, to each centre not further than a ratio of that distance. The ratio
also selects the lists that a vector searches: it looks into those it is posted to. Lists are compared by matrix products, long
ones in blocks, exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.vectors import CentroidGraph, as_first, balanced_centres, blocked, crowded, float_lists, in_batches, lists_of, matrix, sample, separated, split_copies
from gleanframe.session import cut


@dataclass(frozen=True)
class IndexSettings:
    """``list_rows``: rows that a list is meant to have. ``group_lists``: lists that a group is meant to have; ``most_groups``
    bounds the groups, which are broadcast (64 dimensions: 0.5 KB each with their links). ``sample_rows`` a centre, of either level, bound the
    samples, ``group_sample`` bounds that of one group. ``separation``: centres are not closer than this cosine. ``overlap``: a centre is in the tables
    of all groups not further than so many times its nearest, up to ``group_width``. ``ratio``: a vector's lists are not further than so many times
    its nearest, up to ``width``. ``unit_rows``: vectors that look up their lists at once. ``block_rows``: rows of a work unit; longer lists are
    compared in pairs of blocks."""

    list_rows: int = 1024
    group_lists: int = 512
    most_groups: int = 8192
    sample_rows: int = 32
    group_sample: int = 1 << 17
    separation: float = 0.85
    overlap: float = 1.15
    group_width: int = 24
    ratio: float = 1.03
    width: int = 8
    unit_rows: int = 8192
    block_rows: int = 4096


@dataclass
class Index:
    """``groups``: the search graph over the groups, ``rows``: about how many vectors each has, ``centres``: (grp, list,
    centre) of every list, with its own group."""

    groups: CentroidGraph
    rows: np.ndarray
    centres: DataFrame


def _routed(rows: DataFrame, vector: str, groups: CentroidGraph, width: int = 1, overlap: float = 1.0) -> DataFrame:
    """``rows`` with ``grp``, once for each of up to ``width`` groups that are not further than ``overlap`` times the nearest."""
    shared = rows.sparkSession.sparkContext.broadcast(groups)
    at = rows.columns.index(vector)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, cosines = shared.value.search(matrix(batch.column(at)), width)
        row, rank = np.nonzero(lists_of(cosines, overlap))
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(ids[row, rank].astype(np.int32))], [*batch.schema.names, "grp"])

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return rows.mapInArrow(in_batches(run), f"{schema}, grp int")


def build_index(vectors: DataFrame, key: str, vector: str, rows: int, settings: IndexSettings, seed: int = 0) -> Index | None:
    """The index of ``vectors``, of which there are about ``rows``: learnt from samples, chosen by a hash of the key."""
    groups = min(settings.most_groups, -(-max(1, rows // settings.list_rows) // settings.group_lists))
    most = groups * settings.sample_rows
    x = sample(vectors, key, vector, most / max(rows, 1), most, seed)
    if not len(x):
        x = sample(vectors, key, vector, 1.0, most, seed)
    if not len(x):
        return None
    graph = CentroidGraph.build(balanced_centres(x, groups))
    share = min(1.0, max(settings.sample_rows / settings.list_rows, 4096 / rows))
    drawn = F.xxhash64(F.lit(seed + 1), F.col(key))
    chosen = vectors.select(drawn.alias("drawn"), vector)
    if share < 1:
        chosen = chosen.where(F.col("drawn") < int(share * 2**53) * 2**11 - 2**63)
    routed = cut(_routed(chosen, vector, graph))
    sizes = np.zeros(len(graph.centres))
    for g, n in routed.groupBy("grp").count().collect():  # a row a group
        sizes[g] = n / share
    over = {g: settings.group_sample / (n * share) for g, n in enumerate(sizes) if n * share > settings.group_sample}
    if over:
        thinner = vectors.sparkSession.createDataFrame([(g, int(share * kept * 2**53) * 2**11 - 2**63) for g, kept in over.items()], "grp int, below bigint")
        routed = routed.join(F.broadcast(thinner), "grp", "left").where("below is null or drawn < below").drop("below")
    shared = vectors.sparkSession.sparkContext.broadcast(sizes)

    def learn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("drawn")  # the same centres in whatever order the rows come
        g, x = table["grp"][0].as_py(), matrix(table[vector])
        k = max(1, min(round(shared.value[g] / settings.list_rows), len(x) // 4))
        found = separated(balanced_centres(x, k), settings.separation)
        return pa.table({"grp": pa.array(np.full(len(found), g, np.int32)), "list": pa.array((np.int64(g) << 32) + np.arange(len(found))), "centre": float_lists(found)})

    centres = cut(routed.groupBy("grp").applyInArrow(learn, "grp int, list bigint, centre array<float>"))
    if len(graph.centres) > 1:
        centres = cut(_kept_apart(centres, graph, settings))
    return Index(graph, sizes, centres)


def _kept_apart(centres: DataFrame, groups: CentroidGraph, settings: IndexSettings) -> DataFrame:
    """Centres without those that are closer than the separation to one of an earlier group."""
    tables = _routed(centres.withColumnRenamed("grp", "own"), "centre", groups, settings.group_width, settings.overlap)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, own, g = matrix(table["centre"]), table["own"].to_numpy(), table["grp"][0].as_py()
        mine, others = np.flatnonzero(own == g), np.flatnonzero(own < g)
        crowd = np.zeros(len(mine), bool)
        for i in range(0, len(mine), 1024):
            crowd[i : i + 1024] = (x[mine[i : i + 1024]] @ x[others].T >= settings.separation).any(1)
        return table.select(["grp", "list", "centre"]).take(pa.array(mine[~crowd]))

    return tables.groupBy("grp").applyInArrow(run, "grp int, list bigint, centre array<float>")


def in_lists(rows: DataFrame, key: str, vector: str, index: Index, settings: IndexSettings, choose: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """``rows`` with ``list`` and ``home`` (whether it is the nearest), once for each of the ``width`` nearest lists that
    ``choose`` (cosines, nearest first, to a mask) takes. Each group's vectors, in parts, meet the group's table of centres."""
    spark = rows.sparkSession
    parts = np.maximum(1, np.ceil(index.rows / settings.unit_rows)).astype(np.int64)
    shared = spark.sparkContext.broadcast(parts)

    def in_parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = dict(zip(batch.schema.names, batch.columns))
        part = column.pop("_drawn").to_numpy() % shared.value[column["grp"].to_numpy()]
        return pa.RecordBatch.from_arrays([*column.values(), pa.array(part.astype(np.int32))], [*column, "part"])

    def repeated(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = shared.value[batch.column(2).to_numpy()]
        row = np.repeat(np.arange(batch.num_rows), n)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    asking = _routed(rows.withColumn("_drawn", F.xxhash64(F.lit("part"), F.col(key))), vector, index.groups).mapInArrow(in_batches(in_parts), f"{schema}, grp int, part int")
    tables = _routed(index.centres.select("list", "centre"), "centre", index.groups, settings.group_width, settings.overlap).mapInArrow(
        in_batches(repeated), "list bigint, centre array<float>, grp int, part int"
    )
    names = rows.columns

    def run(asking: pa.Table, table: pa.Table) -> pa.Table:
        table, asking = table.combine_chunks().sort_by("list"), asking.combine_chunks()
        row = rank = np.zeros(0, int)
        lists = pa.array([], pa.int64())
        if table.num_rows and asking.num_rows:
            ids, cosines = CentroidGraph.build(matrix(table["centre"])).search(matrix(asking[vector]), width)
            row, rank = np.nonzero(choose(cosines))
            lists = table["list"].combine_chunks().take(pa.array(ids[row, rank]))
        return pa.table({**{n: asking[n].take(pa.array(row)) for n in names}, "list": lists, "home": pa.array(rank == 0)})

    return asking.groupBy("grp", "part").cogroup(tables.groupBy("grp", "part")).applyInArrow(run, f"{schema}, list bigint, home boolean")


def post(vectors: DataFrame, key: str, vector: str, index: Index, settings: IndexSettings) -> DataFrame:
    """(key, vector, list, home): each vector in all its lists; ``home`` marks the nearest."""
    return in_lists(vectors.select(key, vector), key, vector, index, settings, lambda cosines: lists_of(cosines, settings.ratio), settings.width)


def top_columns(cosines: np.ndarray, k: int) -> np.ndarray:
    """For each row the columns of the k greatest cosines at six decimals, of equal ones the first columns; -1 where fewer
    are above -1.5."""
    n = cosines.shape[1]
    k = min(k, n)
    rank = np.rint(cosines * 1e6) * 4194304.0 - np.arange(n)
    best = np.argpartition(-rank, k - 1, 1)[:, :k] if k < n else np.broadcast_to(np.arange(n), cosines.shape).copy()
    rows = np.arange(len(cosines))[:, None]
    best = best[rows, np.argsort(-rank[rows, best], 1)]
    return np.where(cosines[rows, best] > -1.5, best, -1)


def _unit(key: str, vector: str, k: int, lowest: float = -1.0) -> Callable[[pa.Table], pa.Table]:
    """The k nearest of each row of a unit, of a cosine of ``lowest`` or more. Single precision leaves a few columns of each
    row; these are compared in double."""
    group, margin = 32, 1e-5  # columns that one maximum stands for; more than the error of single precision and of six decimals

    def best(x: np.ndarray, of: np.ndarray, among: np.ndarray, out: list) -> None:
        single = x.astype(np.float32)
        columns = np.ascontiguousarray(single[among].T)
        whole = len(among) // group * group
        for i in range(0, len(of), 256):
            part = of[i : i + 256]
            c = single[part] @ columns
            if of is among:
                c[np.arange(len(part)), np.arange(i, i + len(part))] = -2
            least = np.full(len(part), max(-1.5, lowest - margin), np.float32)
            if whole >= k * group:
                # The k-th greatest of the groups' maxima is not above the k-th greatest of all.
                most = c[:, :whole].reshape(len(part), -1, group).max(2)
                least = np.maximum(least, np.partition(most, most.shape[1] - k, 1)[:, -k] - np.float32(margin))
            row, col = np.divmod(np.flatnonzero(c >= least[:, None]), len(among))
            a, b = part[row], among[col]
            cosine = np.round(np.clip(np.einsum("ij,ij->i", x[a], x[b]), -1, 1), 6)
            reached = cosine >= lowest
            a, b, row, col, cosine = a[reached], b[reached], row[reached], col[reached], cosine[reached]
            order = np.lexsort((col, -cosine, row))
            row = row[order]
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            out.append((a[order], b[order], cosine[order]))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(key)  # ties go to the first column
        block, x, names = table["block"].to_numpy(), matrix(table[vector]), table[key].combine_chunks()
        a, b = (np.flatnonzero(block == table[unit][0].as_py()) for unit in ("unit_a", "unit_b"))
        found: list = []
        if table["unit_a"][0].as_py() == table["unit_b"][0].as_py():
            best(x, a, a, found)
        elif len(a) and len(b):
            best(x, a, b, found)
            best(x, b, a, found)
        of, other, cosine = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in range(3))
        order = np.argsort(of, kind="stable")
        of, other, cosine = of[order], other[order], cosine[order]
        who, start = np.unique(of, return_index=True)
        near = pa.StructArray.from_arrays([pa.array(-np.asarray(cosine, np.float64)), names.take(pa.array(other))], ["minus", "id"])
        offsets = pa.array(np.concatenate([start, [len(of)]]) if len(who) else np.zeros(1, int), pa.int32())
        return pa.table({key: names.take(pa.array(who)), "near": pa.ListArray.from_arrays(offsets, near)})

    return run


def _ranked(near: DataFrame, extra: DataFrame | None, key: str, k: int) -> DataFrame:
    """(key, neighbour, cosine, rank) of what the units found, with the rows of the copies that were left out."""
    merged = near.groupBy(key).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    if extra is not None:
        # A further copy has what the first copy has, and the first copy itself, at 1.
        first = F.array(F.struct(F.lit(-1.0).alias("minus"), F.col(key).alias("id")))
        merged = cut(merged)
        copied = as_first(extra, merged.select(key, F.slice(F.array_sort(F.concat(first, "near")), 1, k).alias("near")), key)
        merged = merged.unionByName(copied.select(key, "near"))
    return merged.select(key, F.posexplode("near").alias("position", "one")).select(
        key, F.col("one.id").alias("neighbour"), (-F.col("one.minus")).alias("cosine"), (F.col("position") + 1).alias("rank")
    )


def nearest_vectors(
    vectors: DataFrame, key: str, vector: str, k: int, least: float = -1.0, settings: IndexSettings = IndexSettings()
) -> DataFrame:
    """(key, neighbour, cosine, rank): for every vector its k most similar others with a cosine of ``least`` or more.

    Cosines are double, rounded to six decimals; ties go to the smaller key. ``vectors`` has one usable vector a key (keys
    not NULL); fewer than k others give fewer rows, an empty table none. Every vector is indexed, copies of one vector by
    their k + 1 least keys; the accuracy loss is pairs that share no list.
    """
    kind = dict(vectors.dtypes)[key]
    vectors, extra = split_copies(cut(vectors.select(key, vector)), key, vector, k + 1)
    index = build_index(vectors, key, vector, vectors.count(), settings)
    if index is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, neighbour {kind}, cosine double, rank int")
    postings = cut(post(vectors, key, vector, index, settings))
    units = blocked(postings, key, "list", crowded(postings, "list", settings.block_rows))
    near = units.select(key, vector, "list", "block", "unit_a", "unit_b").groupBy("list", "unit_a", "unit_b").applyInArrow(
        _unit(key, vector, k, least), f"`{key}` {kind}, near array<struct<minus:double,id:{kind}>>"
    )
    return _ranked(near, extra, key, k)


def every_nearest(vectors: DataFrame, key: str, vector: str, k: int, block_rows: int = 1 << 14) -> DataFrame:
    """(key, neighbour, cosine, rank) as ``nearest_vectors`` gives it, but by comparing every two vectors: nothing is lost.

    For neighbours at any distance: those far away share no list. Work grows with the square of the rows, what is shuffled
    with rows / ``block_rows`` times the rows; copies of one vector are compared by their k + 1 least keys.
    """
    kind = dict(vectors.dtypes)[key]
    vectors, extra = split_copies(cut(vectors.select(key, vector)), key, vector, k + 1)
    one = vectors.withColumn("list", F.lit(0))
    units = blocked(one, key, "list", crowded(one, "list", block_rows))
    near = units.select(key, vector, "block", "unit_a", "unit_b").groupBy("unit_a", "unit_b").applyInArrow(
        _unit(key, vector, k), f"`{key}` {kind}, near array<struct<minus:double,id:{kind}>>"
    )
    return _ranked(near, extra, key, k)


def recall_against(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(pairs, found, recall) of ``exact``'s (key, neighbour) pairs that ``found`` has."""
    hit = exact.select(key, "neighbour").join(found.select(key, "neighbour", F.lit(1).alias("hit")), [key, "neighbour"], "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("pairs"))


def exact_nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, most_queries: int = 1 << 14) -> DataFrame:
    """(key, neighbour, cosine) of each of ``queries`` by comparing it with every vector: the measure for recall.

    The queries, up to ``most_queries``, are broadcast; more are an error.
    """
    table = queries.select(key, vector).limit(most_queries + 1).toArrow().combine_chunks()
    if table.num_rows > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    kind = dict(vectors.dtypes)[key]
    shared = vectors.sparkSession.sparkContext.broadcast((table[key].to_pylist(), matrix(table[vector])))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, q = shared.value
        mine = batch.column(0).to_pylist()
        order = np.asarray(sorted(range(len(mine)), key=lambda i: mine[i]))
        x = matrix(batch.column(1))[order]
        sorted_names = np.asarray(mine, object)[order]
        parts = []
        for i in range(0, len(q), 1024):
            c = np.round(np.clip(q[i : i + 1024] @ x.T, -1, 1), 6)
            c[np.asarray(names[i : i + 1024], object)[:, None] == sorted_names[None, :]] = -2
            top = top_columns(c, k)
            row, rank = np.nonzero(top >= 0)
            parts.append((row + i, top[row, rank], c[row, top[row, rank]]))
        row, col, c = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, int) for j in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array([names[r] for r in row], table.schema.field(key).type), pa.array(list(sorted_names[col]), table.schema.field(key).type), pa.array(np.asarray(c, float))],
            [key, "neighbour", "cosine"],
        )

    every = vectors.select(key, vector).mapInArrow(in_batches(run), f"`{key}` {kind}, neighbour {kind}, cosine double")
    best = every.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "neighbour"))), 1, k).alias("near"))
    return best.select(key, F.explode("near").alias("one")).select(key, F.col("one.neighbour").alias("neighbour"), (-F.col("one.minus")).alias("cosine"))
