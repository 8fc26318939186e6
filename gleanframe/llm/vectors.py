"""Vectors of records: current and usable ones, samples, centroids, and a search graph over centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.ids import clean_id
from gleanframe.operators.current import current_rows
from gleanframe.operators.skew import heaviest, salted_join
from gleanframe.session import cut


def usable(vector: str, dimensions: int) -> Column:
    """The vector has exactly so many elements, all finite numbers and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def current_vectors(results: DataFrame, profiles: DataFrame, dimensions: int = 64) -> DataFrame:
    """(photo_id, vector) of each photo whose latest result of the default profile is usable.

    Without a default profile there are none. Of results of one time the greatest result_id counts; a result without a time
    is the oldest. Photo ids are tidied; NULL or blank ones are left out.
    """
    default = profiles.where("is_default = 1").select(clean_id("profile_id").alias("p")).orderBy(F.col("created_at").desc(), "p").first()
    rows = results.where(clean_id("profile_id") == (default["p"] if default else None)).select(
        clean_id("photo_id").alias("photo_id"), "created_at", clean_id("result_id").alias("result_id"), "vector"
    )
    latest = current_rows(rows, "photo_id", [F.col("created_at").desc_nulls_last(), F.col("result_id").desc_nulls_last()])
    return latest.where(usable("vector", dimensions)).select("photo_id", F.col("vector").cast("array<float>").alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length (double) of an Arrow column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # In two steps, so that neither very large nor very small elements leave the range of numbers.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def float_lists(x: np.ndarray) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(x.astype(np.float32).ravel()))


def sample(vectors: DataFrame, key: str, vector: str, share: float, most: int, seed: int = 0) -> np.ndarray:
    """Unit rows of about that share of records, chosen by a hash of their key, ``most`` at most; sorted by the hash."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    chosen = vectors.select(h.alias("h"), vector)
    if share < 1:
        chosen = chosen.where(F.col("h") < int(share * 2**53) * 2**11 - 2**63)
    table = chosen.limit(most).toArrow()
    x = matrix(table.column(1)) if table.num_rows else np.zeros((0, 0))
    return x[np.argsort(table.column(0).to_numpy(), kind="stable")] if len(x) else x


def separated(centres: np.ndarray, cosine: float) -> np.ndarray:
    """The centres without those closer to an earlier one than ``cosine``."""
    kept = centres[:0]
    for i in range(0, len(centres), 1024):
        part = centres[i : i + 1024]
        free = (part @ kept.T < cosine).all(1) if len(kept) else np.ones(len(part), bool)
        own = part @ part.T >= cosine
        chosen: list[int] = []
        for j in np.flatnonzero(free):
            if not own[j, chosen].any():
                chosen.append(int(j))
        kept = np.concatenate([kept, part[chosen]])
    return kept


def _nearest_centre(x: np.ndarray, centres: np.ndarray, crowd: np.ndarray | float = 0.0) -> np.ndarray:
    step = max(64, (1 << 22) // len(centres))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - crowd, 1) for i in range(0, len(x), step)])


def balanced_centres(x: np.ndarray, k: int, rounds: int = 6, weight: float = 0.05) -> np.ndarray:
    """Unit centres of ``x`` by spherical k-means, in which a crowded centre is a little further away for everyone.

    Many centres are learnt in two levels, each group of the first level getting its share of them.
    """
    if not len(x):
        return x
    k = min(k, len(x))
    if k > 1024:
        coarse = balanced_centres(x, int(np.sqrt(k)), rounds, weight)
        group = _nearest_centre(x, coarse)
        parts = [x[group == g] for g in range(len(coarse))]
        return np.concatenate([balanced_centres(p, max(1, round(k * len(p) / len(x))), rounds, weight) for p in parts if len(p)])
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    crowd = np.zeros(k)
    for _ in range(rounds):
        label = _nearest_centre(x, centres, crowd)
        counts = np.bincount(label, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
        crowd = weight * np.log1p(counts * k / len(x))
    return centres


@dataclass
class CentroidGraph:
    """A navigable graph over centroids, searched best first for many queries at once."""

    centres: np.ndarray
    links: np.ndarray
    hubs: np.ndarray

    @staticmethod
    def build(centres: np.ndarray, degree: int = 24) -> CentroidGraph:
        """Each centre is linked with those nearest to it, with those that it is nearest to, and, against dead ends, with its
        neighbours in number."""
        n = len(centres)
        degree = min(degree, max(n - 1, 1))
        # Single precision finds the same lists at half the cost; cosines of results are computed elsewhere, in double.
        centres = centres.astype(np.float32)
        near = np.zeros((n, degree), np.int32)
        for i in range(0, n, 2048):
            s = centres[i : i + 2048] @ centres.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            near[i : i + len(s)] = np.argpartition(-s, degree - 1, 1)[:, :degree] if n > 1 else 0
        # Ways back, as many again: a centre that is nobody's neighbour would not be found.
        to, of = near.ravel(), np.repeat(np.arange(n, dtype=np.int32), degree)
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        back = np.repeat(((np.arange(n) + 1) % n).astype(np.int32)[:, None], degree, 1)
        kept = place < degree
        back[to[kept], place[kept]] = of[kept]
        around = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], 1).astype(np.int32)
        hubs = np.unique(np.linspace(0, n - 1, max(1, int(4 * np.sqrt(n)))).astype(int))
        return CentroidGraph(centres, np.concatenate([near, back, around], 1), hubs)

    def search(self, x: np.ndarray, width: int, beam: int = 64, grow: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` up to ``width`` near centres, nearest first, with their cosines; -1 and -2 where fewer.

        A search goes on until the ``beam`` best centres seen have all been left by their links, so none that they lead to is
        better. A graph of no more centres than a search would look at is looked at whole.
        """
        beam = max(beam, width)
        ids, cosines = np.full((len(x), width), -1, np.int32), np.full((len(x), width), -2.0)
        whole = len(self.centres) <= beam * self.links.shape[1]
        for i in range(0, len(x), 512):
            part = x[i : i + 512].astype(np.float32)
            found, c = self._scan(part, width) if whole else self._search(part, beam, grow)
            ids[i : i + 512, : found.shape[1]], cosines[i : i + 512, : found.shape[1]] = found[:, :width], c[:, :width]
        return ids, cosines

    def _scan(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        c = x @ self.centres.T
        width = min(width, c.shape[1])
        rows = np.arange(len(x))[:, None]
        best = np.argpartition(-c, width - 1, 1)[:, :width]
        best = best[rows, np.argsort(-c[rows, best], 1, kind="stable")]
        return best, c[rows, best]

    def _search(self, x: np.ndarray, beam: int, grow: int) -> tuple[np.ndarray, np.ndarray]:
        n, b = len(self.centres), len(x)
        near = x @ self.centres[self.hubs].T
        first = min(grow, len(self.hubs))
        start = np.argpartition(-near, first - 1, 1)[:, :first]
        every = np.arange(b)[:, None]
        ids, cos = np.full((b, beam), -1, np.int64), np.full((b, beam), -2.0, np.float32)
        ids[:, :first], cos[:, :first] = self.hubs[start], near[every, start]
        left = ids < 0  # whose links have been followed
        seen = np.zeros((b, n), bool)
        seen[every, ids[:, :first]] = True
        active = np.arange(b)
        while len(active):
            rows = np.arange(len(active))[:, None]
            i, c, d = ids[active], cos[active], left[active]
            order = np.argsort(np.where(d, 3.0, -c), 1, kind="stable")[:, :grow]
            fresh = ~d[rows, order]
            going = fresh.any(1)
            if not going.all():
                active = active[going]
                continue
            d[rows, order] = True
            more = np.sort(np.where(fresh[:, :, None], self.links[np.maximum(i[rows, order], 0)], n).reshape(len(active), -1), 1)
            new = more < n
            new[:, 1:] &= more[:, 1:] != more[:, :-1]
            more = np.minimum(more, n - 1)
            new &= ~seen[active[:, None], more]
            row, col = np.nonzero(new)
            seen[active[row], more[row, col]] = True
            value = np.full(more.shape, -2.0, np.float32)
            value[row, col] = np.einsum("kd,kd->k", self.centres[more[row, col]], x[active[row]])
            every_id, every_cos = np.concatenate([i, more], 1), np.concatenate([c, value], 1)
            every_left = np.concatenate([d, ~new], 1)
            best = np.argpartition(-every_cos, beam - 1, 1)[:, :beam]
            ids[active], cos[active], left[active] = every_id[rows, best], every_cos[rows, best], every_left[rows, best]
        best = np.argsort(-cos, 1, kind="stable")
        return np.where(cos > -1.5, ids, -1)[every, best], cos[every, best]


def lists_of(cosines: np.ndarray, ratio: float) -> np.ndarray:
    """Which of the centres found (nearest first) a record belongs to: those not further than ``ratio`` times the nearest."""
    distance = np.sqrt(np.maximum(2 - 2 * cosines, 0))
    return (cosines > -1.5) & (distance <= ratio * np.maximum(distance[:, :1], 1e-9))


def crowded(rows: DataFrame, lists: str, most: int) -> DataFrame:
    """(lists, blocks) of the lists of more than ``most`` rows: in how many blocks they are divided."""
    n = F.count(F.lit(1))
    return cut(rows.groupBy(lists).agg(n.alias("n")).where(F.col("n") > most).select(lists, F.ceil(F.col("n") / most).cast("int").alias("blocks")))


def with_blocks(rows: DataFrame, lists: str, hot: DataFrame, spread: Column) -> DataFrame:
    """``rows`` with ``blocks``, 1 where a list isn't in ``hot``.

    Few crowded lists are broadcast. Beyond 2¹⁸ of them (of 12 bytes each) the rows are joined, a list's rows in 64 parts by
    ``spread``, as these lists are the ones with many rows.
    """
    if hot.count() <= 1 << 18:
        found = rows.join(F.broadcast(hot), lists, "left")
    else:
        parts = hot.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(63))))
        found = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), spread), F.lit(64)).cast("int")).join(parts, [lists, "_part"], "left").drop("_part")
    return found.withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def blocked(postings: DataFrame, key: str, lists: str, hot: DataFrame) -> DataFrame:
    """Each row once for each work unit that it takes part in: (…, unit_a, unit_b, block).

    A list that isn't in ``hot`` (as ``crowded`` gives it) is one unit. The others are divided into blocks by a hash of the key,
    and each pair of blocks is a unit, so that all pairs of rows of a list meet in exactly one unit (rows of one block in their own).
    """
    with_block = with_blocks(postings, lists, hot, F.col(key)).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.col("blocks")).cast("int"))
    return (
        with_block.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"unit_a": F.least("block", "_other"), "unit_b": F.greatest("block", "_other")})
        .drop("blocks", "_other")
    )


def split_copies(vectors: DataFrame, key: str, vector: str, keep: int) -> tuple[DataFrame, DataFrame | None]:
    """Vectors without the copies beyond the ``keep`` least keys of each vector, and those copies as (key, first, copies).

    Work between rows of one list grows with the square of their number; what copies add to it is known without comparing
    them. Vectors are told apart by two 64-bit hashes. ``vectors`` should be kept rows, as it is read more than once; without
    crowded vectors it comes back as it is, with None.
    """
    narrow = vectors.select(key, F.xxhash64(F.lit(0), vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"))
    many = cut(narrow.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first")).where(F.col("copies") > keep))
    if many.isEmpty():
        return vectors, None
    copies = salted_join(narrow, many, ["h1", "h2"], heaviest(many, ["h1", "h2"], "copies"), F.col(key))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(key))  # of which only the first leave a partition
    front = copies.withColumn("place", place).where(F.col("place") <= keep).select(key)
    extra = cut(copies.join(front, key, "left_anti").select(key, "first", "copies"))
    return vectors.join(extra.select(key), key, "left_anti"), extra


def as_first(extra: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``found`` (key, …) of the first copies, for each of their further copies ``extra``."""
    most = extra.groupBy("first").agg(F.first("copies").alias("copies"))
    return salted_join(extra, found.withColumnRenamed(key, "first"), ["first"], heaviest(most, ["first"], "copies"), F.col(key)).drop("first", "copies")


def in_batches(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                yield function(batch)

    return run
