"""Filling fixed-capacity containers with items of varying length.

Harmonic packing: the sizes above capacity / (j + 1) and up to capacity / j are class j, and a container opened for class j takes
exactly j items of that class, which always fit; only the last one of a class may have fewer. Harmonic packing alone leaves the
rest of such a container empty. A second step, the top-up, fills it with the largest sizes of later classes that fit; what the
top-up has used is no longer there when its own class is opened.

Both steps work on the table of sizes (at most the capacity many entries), not on items. The plan is a short list of patterns,
each used for a run of containers, so which container an item goes to follows from its number among the items of its size:
workers fill independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import cut

#: Items numbered in one sort group; a size with more items is numbered in several.
NUMBERED_AT_ONCE = 1 << 20


#: Above any capacity: a window and a size together are one number.
_SIZES = 1 << 40


def _slot(window: int, size: int) -> int:
    return window * _SIZES + size


@dataclass
class Plan:
    """``rows``: for each size, intervals of item numbers: (size, first number, first container, items of the size in a container).
    ``opened``: runs of containers of one class: (first container, containers, class, items of the class in each)."""

    capacity: int
    containers: int = 0
    rows: list[tuple[int, int, int, int]] = field(default_factory=list)
    opened: list[tuple[int, int, int, int]] = field(default_factory=list)


class _Stock:
    """The items that are left of each size, largest first."""

    def __init__(self, counts: dict[int, int]):
        self.sizes = sorted(counts, reverse=True)
        self.left = [counts[s] for s in self.sizes]
        self.used = [0] * len(self.sizes)
        self.ascending = np.asarray(self.sizes[::-1])
        # following[i]: the next place from i on of which items are left, with shortcuts
        self.following = list(range(len(self.sizes) + 1))

    def next(self, i: int) -> int:
        root = i
        while self.following[root] != root:
            root = self.following[root]
        while self.following[i] != root:
            self.following[i], i = root, self.following[i]
        return root

    def fitting(self, i: int, room: int) -> int:
        """The first place from i on of a size that fits."""
        if i < len(self.sizes) and self.sizes[i] > room:
            i = max(i, len(self.sizes) - int(np.searchsorted(self.ascending, room, "right")))
        return self.next(i)

    def take(self, i: int, n: int) -> None:
        self.used[i] += n
        self.left[i] -= n
        if not self.left[i]:
            self.following[i] = i + 1


def class_items(stock: _Stock, first: int, capacity: int) -> list[tuple[int, int]]:
    """(place, items): the fixed count of items of the class of the size at ``first``, from there down; fewer if there aren't more."""
    j = need = capacity // stock.sizes[first]
    pattern, at = [], first
    while need and at < len(stock.sizes) and capacity // stock.sizes[at] == j:
        n = min(stock.left[at], need)
        pattern.append((at, n))
        need -= n
        at = stock.next(at + 1)
    return pattern


def top_up(stock: _Stock, after: int, room: int) -> list[tuple[int, int]]:
    """(place, items) of the largest sizes after the place ``after`` that fit into the room that a class leaves."""
    pattern, at = [], stock.fitting(stock.next(after + 1), room)
    while at < len(stock.sizes) and room:
        n = min(stock.left[at], room // stock.sizes[at])
        pattern.append((at, n))
        room -= n * stock.sizes[at]
        at = stock.fitting(stock.next(at + 1), room)
    return pattern


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    """The patterns for ``counts`` items of each size, 1 to ``capacity``: class after class, each opened container with its
    class's count and a top-up. Each step uses up one size or comes within one container of it, so the steps grow with the
    number of sizes and not with that of items."""
    plan, stock = Plan(capacity), _Stock(counts)
    while (first := stock.next(0)) < len(stock.sizes):
        own = class_items(stock, first, capacity)
        room = capacity - sum(stock.sizes[k] * n for k, n in own)
        pattern = own + top_up(stock, own[-1][0], room)
        times = min(stock.left[k] // n for k, n in pattern)
        plan.opened.append((plan.containers, times, capacity // stock.sizes[first], sum(n for _, n in own)))
        for k, n in pattern:
            plan.rows.append((stock.sizes[k], stock.used[k], plan.containers, n))
            stock.take(k, n * times)
        plan.containers += times
    return plan


def _locate(plans: dict[int, Plan], window: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The container of each item, from its size and its number among the items of that size."""
    out = np.zeros(len(size), np.int64)
    for w, plan in plans.items():
        here = np.flatnonzero(window == w)
        if not len(here):
            continue
        rows = np.asarray(sorted(plan.rows), np.int64)
        # one sorted key for (size, number): sizes are at most the capacity
        base = np.int64(max(int(rows[:, 1].max()), int(number[here].max())) + 1)
        at = np.searchsorted(rows[:, 0] * base + rows[:, 1], size[here] * base + number[here], "right") - 1
        out[here] = rows[at, 2] + (number[here] - rows[at, 1]) // rows[at, 3]
    return out


def pack(items: DataFrame, windows: dict[int, int], key: str, size: str) -> DataFrame:
    """Items in containers: (window_id, container_id, key, piece_no, first_unit, n_units).

    ``windows``: window_id to capacity, at least 1; they are packed independently. An item larger than a capacity, and only
    such a one, is split: into full containers and a rest that is packed as an item. Items of size 0 or NULL are left out,
    repeated rows are items of their own, an empty table gives no rows. ``key`` must be orderable; ties of size are
    numbered by key.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[key]
    columns = f"window_id int, container_id bigint, `{key}` {kind}, piece_no int, first_unit bigint, n_units bigint"
    if not windows:
        return spark.createDataFrame([], columns)
    sized = items.select(F.col(key), F.col(size).cast("bigint").alias("n")).where("n > 0")
    capacities = F.array(*(F.struct(F.lit(int(w)).alias("window_id"), F.lit(int(c)).alias("capacity")) for w, c in windows.items()))
    split = (
        sized.select(key, "n", F.inline(capacities))
        .select(key, "n", "window_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("capacity")))).alias("piece_no"))
        .select("window_id", key, F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("first_unit"), F.least("capacity", F.col("n") - F.col("piece_no") * F.col("capacity")).alias("n_units"))
    )
    counts: dict[int, dict[int, int]] = {int(w): {} for w in windows}
    for w, s, c in split.groupBy("window_id", "n_units").count().collect():  # at most the sum of the capacities
        counts[w][s] = c
    plans = {w: plan_containers(c, int(windows[w])) for w, c in counts.items() if c}
    if not plans:
        return spark.createDataFrame([], columns)
    # Number the items of each size: within salts where there are many, then salts one after another. At most as many
    # sizes are hot as the capacities have units.
    hot = {_slot(w, s): -(-c // NUMBERED_AT_ONCE) for w, sizes in counts.items() for s, c in sizes.items() if c > NUMBERED_AT_ONCE}
    salted = split.withColumn("salt", F.lit(0))
    starts: dict[int, np.ndarray] = {}
    if hot:
        parts = spark.createDataFrame([(slot // _SIZES, slot % _SIZES, n) for slot, n in hot.items()], "window_id int, n_units bigint, parts int")
        salt = F.pmod(F.xxhash64(key, "piece_no"), F.coalesce("parts", F.lit(1))).cast("int")
        salted = split.join(F.broadcast(parts), ["window_id", "n_units"], "left").withColumn("salt", salt)
        for w, s, salt, c in salted.where("parts > 1").groupBy("window_id", "n_units", "salt").count().collect():
            starts.setdefault(_slot(w, s), np.zeros(hot[_slot(w, s)] + 1, np.int64))[salt + 1] = c
        starts = {k: np.cumsum(v) for k, v in starts.items()}
    order = Window.partitionBy("window_id", "n_units", "salt").orderBy(key, "piece_no")
    numbered = salted.withColumn("number", F.row_number().over(order).cast("bigint") - 1)
    shared = spark.sparkContext.broadcast((plans, starts))

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, starts = shared.value
        for batch in stream:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            window, units, salt, number = (col[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("window_id", "n_units", "salt", "number"))
            if starts:
                slots, of = np.unique(window * _SIZES + units, return_inverse=True)
                for i, k in enumerate(slots.tolist()):
                    if k in starts:
                        here = of == i
                        number[here] += starts[k][salt[here]]
            container = _locate(plans, window, units, number)
            yield pa.RecordBatch.from_arrays(
                [col["window_id"], pa.array(container), col[key], col["piece_no"], col["first_unit"], col["n_units"]],
                ["window_id", "container_id", key, "piece_no", "first_unit", "n_units"],
            )

    return numbered.mapInArrow(place, columns)


def pack_documents(tokens: DataFrame, windows: dict[int, int], key: str = "doc_id") -> DataFrame:
    """``pack`` of (key, n_tokens), counted once and kept."""
    return pack(cut(tokens), windows, key, "n_tokens")


def utilisation(packed: DataFrame, windows: dict[int, int]) -> DataFrame:
    """(window_id, containers, units, unused_share) of ``pack``'s result."""
    capacity = F.lit(None).cast("bigint")
    for w, c in windows.items():
        capacity = F.when(F.col("window_id") == w, F.lit(c)).otherwise(capacity)
    return (
        packed.groupBy("window_id")
        .agg(F.count_distinct("container_id").alias("containers"), F.sum("n_units").alias("units"))
        .withColumn("unused_share", F.round(1 - F.col("units") / (F.col("containers") * capacity), 6))
    )
