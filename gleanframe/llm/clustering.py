"""Grouping vectors into clusters of mutually similar records.

Each partition grows a cluster-feature tree (count, sum and sum of squares of a leaf's vectors) that absorbs a vector where its
mean cosine with a leaf's members reaches the limit; sums of unit vectors give mean cosines between leaves exactly. Leaf
summaries of all partitions are reduced together by region, since a tree of partitions would end in one task with all leaves: each
goes to its lists of an index, boundary leaves to several, and is merged there by Ward's criterion with those whose mean
cosine reaches the limit. What several lists have merged with a common leaf is one summary, by connected components. A set whose members all reach the limit with each other and with no one else is never split or mixed
by either rule, so it arrives as one summary. One pass then assigns every vector to the summary with the greatest mean cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.neighbours import Index, IndexSettings, build_index, in_lists, post
from gleanframe.llm.vectors import as_first, blocked, crowded, float_lists, lists_of, matrix, split_copies, with_blocks
from gleanframe.operators.components import connected_components
from gleanframe.operators.skew import heaviest, salted_join
from gleanframe.session import cut


@dataclass(frozen=True)
class ClusterSettings:
    """``fan``: entries of a tree node. ``most_leaves``: leaves a partition's tree holds before it hands them on and starts
    anew. ``leaf_ratio`` and ``leaf_width``: a leaf goes to the lists not further than so many times its nearest, and to no more.
    ``spread``: lists that a cluster is sent to at first; it then goes to every other list of a member. ``index`` lays out the
    lists in which leaves are merged and vectors assigned and compared."""

    fan: int = 24
    most_leaves: int = 20000
    leaf_ratio: float = 1.03
    leaf_width: int = 6
    spread: int = 32
    index: IndexSettings = IndexSettings()


class FeatureTree:
    """A cluster-feature tree over unit vectors."""

    def __init__(self, dimensions: int, limit: float, fan: int):
        self.limit, self.fan, self.d = limit, fan, dimensions
        self.leaves = 0
        self.root = self._node(True)

    def _node(self, leaf: bool) -> dict:
        return {"sum": np.zeros((self.fan + 1, self.d)), "count": np.zeros(self.fan + 1), "used": 0, "below": None if leaf else []}

    def add_all(self, x: np.ndarray) -> None:
        """Adds rows: those that leaves absorb all at once, the others one by one."""
        for row in x[self._absorb(self.root, x)] if self.leaves else x:
            self.add(row)

    def _absorb(self, node: dict, x: np.ndarray) -> np.ndarray:
        """Which rows no leaf below ``node`` absorbs."""
        used = node["used"]
        score = x @ (node["sum"][:used] / node["count"][:used, None]).T
        best = score.argmax(1)
        left = score[np.arange(len(x)), best] < self.limit if node["below"] is None else np.zeros(len(x), bool)
        for i in np.unique(best):
            rows = np.flatnonzero(best == i)
            if node["below"] is not None:
                left[rows] = self._absorb(node["below"][i], x[rows])
            taken = rows[~left[rows]]
            node["sum"][i] += x[taken].sum(0)
            node["count"][i] += len(taken)
        return left

    def add(self, x: np.ndarray) -> None:
        split = self._add(self.root, x)
        if split:
            root = self._node(False)
            for node in split:
                self._append(root, node["sum"][: node["used"]].sum(0), node["count"][: node["used"]].sum(), node)
            self.root = root

    def _append(self, node: dict, total: np.ndarray, count: float, below: dict | None) -> None:
        i = node["used"]
        node["sum"][i], node["count"][i] = total, count
        node["used"] = i + 1
        if below is not None:
            node["below"].append(below)

    def _add(self, node: dict, x: np.ndarray) -> tuple[dict, dict] | None:
        used = node["used"]
        if used:
            score = node["sum"][:used] @ x / node["count"][:used]
            i = int(score.argmax())
        if node["below"] is None:
            if used and score[i] >= self.limit:
                node["sum"][i] += x
                node["count"][i] += 1
                return None
            self._append(node, x, 1, None)
            self.leaves += 1
        else:
            split = self._add(node["below"][i], x)
            if split is None:
                node["sum"][i] += x
                node["count"][i] += 1
                return None
            for k, part in zip((i, None), split):
                total, count = part["sum"][: part["used"]].sum(0), part["count"][: part["used"]].sum()
                if k is None:
                    self._append(node, total, count, part)
                else:
                    node["sum"][k], node["count"][k], node["below"][k] = total, count, part
        return self._split(node) if node["used"] > self.fan else None

    def _split(self, node: dict) -> tuple[dict, dict]:
        """Two nodes around the two entries that are furthest apart."""
        n = node["used"]
        mean = node["sum"][:n] / node["count"][:n, None]
        cosine = mean @ mean.T
        a, b = divmod(int(cosine.argmin()), n)
        if a == b:
            b = (a + 1) % n
        to_b = cosine[:, b] > cosine[:, a]
        to_b[a], to_b[b] = False, True
        parts = (self._node(node["below"] is None), self._node(node["below"] is None))
        for i in range(n):
            self._append(parts[int(to_b[i])], node["sum"][i], node["count"][i], None if node["below"] is None else node["below"][i])
        return parts

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of all leaves."""
        sums, counts, stack = [], [], [self.root]
        while stack:
            node = stack.pop()
            if node["below"] is None:
                sums.append(node["sum"][: node["used"]])
                counts.append(node["count"][: node["used"]])
            else:
                stack += node["below"]
        return np.concatenate(sums), np.concatenate(counts)


def ward(mean: np.ndarray, count: np.ndarray, limit: float) -> np.ndarray:
    """The cluster number of each summary: always the admissible pair (mean cosine of ``limit`` or more) with the least Ward
    cost is merged, until there is none."""
    n = len(mean)
    mean, count = mean.copy(), count.astype(float).copy()
    owner, alive = np.arange(n), np.ones(n, bool)
    partners: list[set[int]] = [set() for _ in range(n)]
    version = [0] * n
    heap: list[tuple[float, int, int, int, int]] = []

    def cost(i: int, j: int) -> float:
        return count[i] * count[j] / (count[i] + count[j]) * float(((mean[i] - mean[j]) ** 2).sum())

    for i in range(0, n, 1024):
        row, col = np.nonzero(mean[i : i + 1024] @ mean.T >= limit)
        row += i
        keep = row < col
        row, col = row[keep], col[keep]
        costs = count[row] * count[col] / (count[row] + count[col]) * ((mean[row] - mean[col]) ** 2).sum(1)
        for c, a, b in zip(costs.tolist(), row.tolist(), col.tolist()):
            partners[a].add(b)
            partners[b].add(a)
            heap.append((c, a, b, 0, 0))
    heapq.heapify(heap)
    while heap:
        _, a, b, va, vb = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or version[a] != va or version[b] != vb:
            continue
        total = count[a] + count[b]
        mean[a] = (mean[a] * count[a] + mean[b] * count[b]) / total
        count[a] = total
        alive[b] = False
        owner[b] = a
        version[a] += 1
        both = {p for p in partners[a] | partners[b] if alive[p] and p != a}
        partners[b] = set()
        partners[a] = set()
        if both:
            others = np.fromiter(both, int)
            for p, cosine in zip(others.tolist(), (mean[others] @ mean[a]).tolist()):
                partners[p].discard(b)
                if cosine >= limit:
                    partners[p].add(a)
                    partners[a].add(p)
                    heapq.heappush(heap, (cost(a, p), a, p, version[a], version[p]))
                else:
                    partners[p].discard(a)
    for i in range(n):
        while owner[owner[i]] != owner[i]:
            owner[i] = owner[owner[i]]
    return owner


_FEATURES = "id bigint, n bigint, mean array<float>"


def _leaf_features(vectors: DataFrame, vector: str, limit: float, settings: ClusterSettings) -> DataFrame:
    """(id, n, mean): the leaves of a feature tree over each partition."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, tree = TaskContext.get().partitionId(), 0, None

        def hand_on(tree: FeatureTree) -> pa.RecordBatch:
            sums, counts = tree.features()
            ids = (np.int64(part) << 40) + made + np.arange(len(counts))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(counts.astype(np.int64)), float_lists(sums / counts[:, None])], ["id", "n", "mean"]
            )

        for batch in stream:
            rows = matrix(batch.column(0)) if batch.num_rows else ()
            for i in range(0, len(rows), 512):
                if tree is None:
                    tree = FeatureTree(rows.shape[1], limit, settings.fan)
                tree.add_all(rows[i : i + 512])
                if tree.leaves >= settings.most_leaves:
                    yield hand_on(tree)
                    made += tree.leaves
                    tree = None
        if tree is not None:
            yield hand_on(tree)

    return vectors.select(vector).mapInArrow(run, _FEATURES)


def _raw(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _ward_links(table: pa.Table, limit: float) -> pa.Table:
    """(u, v) of the summaries of a unit that Ward agglomeration merges."""
    table = table.combine_chunks().sort_by("id")
    owner, ids = ward(_raw(table["mean"]), table["n"].to_numpy(), limit), table["id"].to_numpy()
    gone = np.flatnonzero(owner != np.arange(len(ids)))
    return pa.table({"u": pa.array(ids[owner[gone]]), "v": pa.array(ids[gone])})


def _reaches(x: np.ndarray, single: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Whether the cosine of rows ``a`` and ``b`` reaches the limit at six decimals; near it single precision doesn't tell."""
    c = single[a] @ single[b].T
    near = c >= limit
    row, col = np.nonzero(np.abs(c - np.float32(limit)) < 1e-5)
    near[row, col] = np.round(np.einsum("ij,ij->i", x[a[row]], x[b[col]]), 6) >= limit
    return near


def _with_clusters(units: DataFrame, clusters: DataFrame, key: str, vector: str, limit: float) -> DataFrame:
    """In each work unit: which cluster each home vector belongs to, and whether a pair of vectors speaks against one.

    Returns (list, key, cluster, cosine, bad): the cluster of a home vector (NULL key: only a verdict), its cosine with the
    cluster's mean, and whether a vector outside reaches the limit with a member or one inside doesn't.
    """
    kind = dict(units.dtypes)[key]

    def run(k: tuple, vectors: pa.Table, found: pa.Table) -> pa.Table:
        vectors, found = vectors.combine_chunks(), found.combine_chunks()
        empty = pa.table({"list": pa.array([], pa.int64()), key: pa.array([], vectors.schema.field(key).type), "cluster": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64()), "bad": pa.array([], pa.bool_())})
        if not vectors.num_rows or not found.num_rows:
            return empty
        found = found.sort_by("id")
        x, means, ids = matrix(vectors[vector]), _raw(found["mean"]), found["id"].to_numpy()
        label = np.full(len(x), -1, np.int64)
        nearest = np.zeros(len(x))
        for i in range(0, len(x), 1024):
            s = x[i : i + 1024] @ means.T
            best = s.argmax(1)
            here = s[np.arange(len(s)), best]
            label[i : i + 1024] = np.where(here >= limit, best, -1)
            nearest[i : i + 1024] = here / np.linalg.norm(means[best], axis=1)
        first, second = k[1].as_py(), k[2].as_py()
        block = vectors["block"].to_numpy()
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        single = x.astype(np.float32)
        against = np.zeros(len(means) + 1, bool)
        for i in range(0, len(a), 1024):
            part = a[i : i + 1024]
            near = _reaches(x, single, part, b, limit)
            inside = (label[part][:, None] == label[b][None, :]) & (label[part] >= 0)[:, None]
            row, col = np.nonzero(near != inside)
            # two vectors without a cluster may be close: there is nothing to speak against
            against[label[part][row]] = True
            against[label[b][col]] = True
        against = against[:-1]
        told = np.flatnonzero(against)
        mine = np.flatnonzero(vectors["home"].to_numpy(zero_copy_only=False) & (label >= 0) & (block == first)) if first == second else np.zeros(0, int)
        names = vectors[key].combine_chunks()
        here = k[0].as_py()
        rows = pa.table({"list": pa.array(np.full(len(mine), here, np.int64)), key: names.take(pa.array(mine)), "cluster": pa.array(ids[label[mine]]), "cosine": pa.array(nearest[mine]), "bad": pa.array(np.zeros(len(mine), bool))})
        verdicts = pa.table({"list": pa.array(np.full(len(told), here, np.int64)), key: pa.nulls(len(told), rows.schema.field(key).type), "cluster": pa.array(ids[told]), "cosine": pa.nulls(len(told), pa.float64()), "bad": pa.array(np.ones(len(told), bool))})
        return pa.concat_tables([rows, verdicts])

    cell = ["list", "unit_a", "unit_b"]
    return units.groupBy(*cell).cogroup(clusters.groupBy(*cell)).applyInArrow(run, f"list bigint, `{key}` {kind}, cluster bigint, cosine double, bad boolean")


def _disagreeing(members: DataFrame, key: str, vector: str, limit: float, most: int) -> DataFrame:
    """(cluster) of which two members don't reach the limit; ``members``: (cluster, key, vector). Blocks, as in lists."""
    units = blocked(members, key, "cluster", crowded(members, "cluster", most))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, block = matrix(table[vector]), table["block"].to_numpy()
        single = x.astype(np.float32)
        a, b = (np.flatnonzero(block == table[c][0].as_py()) for c in ("unit_a", "unit_b"))
        apart = not all(_reaches(x, single, a[i : i + 1024], b, limit).all() for i in range(0, len(a), 1024))
        return pa.table({"cluster": pa.array([table["cluster"][0].as_py()] * apart, pa.int64())})

    return units.groupBy("cluster", "unit_a", "unit_b").applyInArrow(run, "cluster bigint").distinct()


def merged_leaves(postings: DataFrame, vector: str, index: Index, limit: float, hot: DataFrame, settings: ClusterSettings) -> DataFrame:
    """(id, n, mean): the leaves of all partitions' trees, those that lists have merged as one. The leaves of a crowded list are
    merged in pairs of its blocks, so that every two meet."""
    features = cut(_leaf_features(postings.where("home"), vector, limit, settings))
    near = lambda cosines: lists_of(cosines, settings.leaf_ratio)
    placed = in_lists(features, "id", "mean", index, settings.index, near, settings.leaf_width).drop("home")
    links = blocked(placed, "id", "list", hot).groupBy("list", "unit_a", "unit_b").applyInArrow(lambda t: _ward_links(t, limit), "u bigint, v bigint")
    labels = connected_components(links)
    one = features.join(labels, features["id"] == labels["v"], "left").select(F.coalesce("label", "id").alias("id"), "n", array_to_vector("mean").alias("mean"))
    return one.groupBy("id").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.mean(F.col("mean"), F.col("n").cast("double")), "float32").alias("mean"))


def _told(postings: DataFrame, sent: DataFrame, key: str, vector: str, limit: float, hot: DataFrame) -> DataFrame:
    """``_with_clusters`` of the lists of ``postings`` and the clusters sent to them: ``sent`` (id, mean, list)."""
    in_units = (
        with_blocks(sent, "list", hot, F.col("id"))
        .withColumn("unit_a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("unit_b", F.explode(F.sequence(F.col("unit_a"), F.col("blocks") - 1)))
        .drop("blocks")
    )
    units = blocked(postings, key, "list", hot).select(key, vector, "home", "list", "block", "unit_a", "unit_b")
    return cut(_with_clusters(units, in_units, key, vector, limit))


def cluster_vectors(
    vectors: DataFrame, key: str, vector: str, limit: float, least: int, settings: ClusterSettings = ClusterSettings()
) -> DataFrame:
    """(key, cluster_id, cosine): the members of clusters, with each one's cosine to its cluster's mean.

    A cluster is a set of ``least`` or more vectors of which every two have a cosine of ``limit`` or more (six decimals) while
    no other vector reaches it with any of them; cluster_id is its least key. ``vectors`` has one usable vector a key (not
    NULL). Vectors that belong nowhere don't come out; an empty table gives no rows. Members are checked against each other
    exactly; outside vectors are looked for in every list that a member is posted to.
    """
    kind = dict(vectors.dtypes)[key]
    vectors, extra = split_copies(cut(vectors.select(key, vector)), key, vector, max(least, 8))
    index = build_index(vectors, key, vector, vectors.count(), settings.index)
    if index is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster_id {kind}, cosine double")
    postings = cut(post(vectors, key, vector, index, settings.index))
    hot = crowded(postings, "list", settings.index.block_rows)
    features = merged_leaves(postings, vector, index, limit, hot, settings)
    clusters = cut(features.where(F.col("n") >= least).select("id", "mean"))
    near = lambda cosines: cosines > -1.5
    sent = cut(in_lists(clusters, "id", "mean", index, settings.index, near, settings.spread).drop("home"))
    told = _told(postings, sent, key, vector, limit, hot)
    while True:
        # A cluster's verdict is whole when it has been in every list of its members.
        members = told.where(F.col(key).isNotNull()).select(key, F.col("cluster").alias("id"))
        wanted = members.join(postings.select(key, "list"), key).select("id", "list").distinct()
        missing = cut(wanted.join(sent.select("id", "list"), ["id", "list"], "left_anti"))
        if missing.isEmpty():
            break
        again = cut(missing.select("list").distinct())
        sent = cut(sent.unionByName(missing.join(clusters, "id")))
        told = cut(told.join(again, "list", "left_anti").unionByName(_told(postings.join(again, "list", "left_semi"), sent.join(again, "list", "left_semi"), key, vector, limit, hot)))
    summary = cut(
        told.groupBy("cluster").agg(
            F.count(key).alias("size"), F.min(key).alias("cluster_id"), F.min("cosine").alias("least_cosine"), F.bool_or("bad").alias("bad")
        ).where((F.col("size") >= least) & ~F.col("bad"))
    )
    heavy = heaviest(summary, ["cluster"], "size")
    home = told.where(F.col(key).isNotNull()).select("cluster", key, "cosine")
    # Within half the limit's angle of the mean every two members reach it; the others are compared.
    wide = summary.where(F.acos("least_cosine") * 2 > float(np.arccos(limit)) - 1e-6).select("cluster")
    compared = salted_join(home.drop("cosine"), wide, ["cluster"], heavy, F.col(key)).join(postings.where("home").select(key, vector), key)
    apart = _disagreeing(compared, key, vector, limit, settings.index.block_rows)
    sound = summary.select("cluster", "cluster_id").join(apart, "cluster", "left_anti")
    valid = salted_join(home, sound, ["cluster"], heavy, F.col(key)).select(key, "cluster_id", "cosine")
    if extra is None:
        return valid
    # Further copies go where the first copy is.
    valid = cut(valid)
    return valid.unionByName(as_first(extra, valid, key).select(key, "cluster_id", "cosine"))


def exact_clusters(vectors: DataFrame, key: str, vector: str, limit: float, least: int, block_rows: int = 1 << 13) -> DataFrame:
    """(key, cluster_id) as ``cluster_vectors`` means it, by comparing every two vectors in blocks: the measure for recall.

    A vector's neighbours, itself included, come out as their number, their least key and a sum of their keys' hashes; a
    cluster is a set of as many vectors of one such outcome as it has neighbours. Work grows with the square of the rows.
    """
    kind = dict(vectors.dtypes)[key]
    one = cut(vectors.select(key, vector, F.xxhash64(key).alias("h"), F.lit(0).alias("list")))
    units = blocked(one, key, "list", crowded(one, "list", block_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(key)  # the first near column is the least key
        x, block, h = matrix(table[vector]), table["block"].to_numpy(), table["h"].to_numpy()
        single = x.astype(np.float32)
        a, b = (np.flatnonzero(block == table[unit][0].as_py()) for unit in ("unit_a", "unit_b"))
        rows, n, first, total = [], [], [], []
        for of, among in ((a, b),) if table["unit_a"][0].as_py() == table["unit_b"][0].as_py() else ((a, b), (b, a)):
            for i in range(0, len(of) if len(among) else 0, 512):
                part = of[i : i + 512]
                near = _reaches(x, single, part, among, limit) | (part[:, None] == among[None, :])
                some = near.any(1)
                near, part = near[some], part[some]
                r, c = np.nonzero(near)
                sums = np.zeros(len(part), np.int64)
                np.add.at(sums, r, h[among[c]])
                rows.append(part)
                n.append(near.sum(1))
                first.append(among[near.argmax(1)] if len(part) else part)
                total.append(sums)
        rows, n, first, total = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, n, first, total))
        names = table[key].combine_chunks()
        return pa.table({key: names.take(pa.array(rows)), "n": pa.array(n.astype(np.int64)), "first": names.take(pa.array(first)), "total": pa.array(total.astype(np.int64))})

    seen = units.groupBy("unit_a", "unit_b").applyInArrow(run, f"`{key}` {kind}, n bigint, first {kind}, total bigint")
    # Each block's sum is a 64-bit one that may have run over; modulo 2⁶⁴ their total doesn't depend on the blocks.
    outcome = seen.groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("cluster_id"), F.pmod(F.sum(F.col("total").cast("decimal(38,0)")), F.lit(str(2**64)).cast("decimal(38,0)")).alias("total"))
    outcome = cut(outcome.where(F.col("n") >= least))
    whole = outcome.groupBy("n", "cluster_id", "total").agg(F.count(F.lit(1)).alias("members")).where("members = n").drop("members")
    return outcome.join(whole, ["n", "cluster_id", "total"]).select(key, "cluster_id")


def describe_clusters(members: DataFrame, key: str, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster's size and the members nearest to its mean, ties by key.

    Only the first ``typical`` rows of a cluster leave a partition, so a cluster of any size is described alike.
    """
    order = Window.partitionBy("cluster_id").orderBy(F.round("cosine", 6).desc(), key)
    first = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    near = first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(key).alias("id")))), lambda x: x["id"]).alias("typical"))
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).join(near, "cluster_id")
