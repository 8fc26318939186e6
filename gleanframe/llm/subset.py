"""Choosing a varied subset by tournament-pivoted rank-revealing QR.

Each partition nominates, by QR with row pivoting, the rows that are least explained by those before them; a tree of pairwise
re-pivots leaves one set of nominees, of which those with enough left over are chosen. Before the next round every row is
deflated by its likeness to the chosen ones, so near-copies of a chosen record shrink to nothing however many there are, and
rounds repeat until k records are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.vectors import float_lists, matrix
from gleanframe.session import cut

#: Partitions' nominees that one task re-pivots, pair by pair.
FAN_IN = 16


def pivoted_rows(x: np.ndarray, most: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` in the order of QR with pivoting, up to ``most``, and what each had left when it was taken.

    Stops where the greatest remainder is below ``tolerance`` times the first. Of equal remainders (six decimals) the first row
    is taken.
    """
    left = np.einsum("ij,ij->i", x, x)
    basis = np.zeros((min(most, *x.shape), x.shape[1]), x.dtype) if len(x) else np.zeros((0, 0))
    order, remainders = [], []
    for j in range(len(basis)):
        i = int(np.argmax(np.round(left, 6)))
        q = x[i] - basis[:j].T @ (basis[:j] @ x[i])
        q -= basis[:j].T @ (basis[:j] @ q)
        norm = float(np.linalg.norm(q))
        if norm < 1e-4 or (remainders and norm < tolerance * remainders[0]):
            break
        order.append(i)
        remainders.append(norm)
        basis[j] = q / norm
        left = left - (x @ basis[j]) ** 2
        left[i] = -1
    return np.asarray(order, int), np.asarray(remainders)


def _deflated(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Unit rows, shrunk by the square of their greatest cosine with a chosen row."""
    if not len(chosen):
        return x
    like = np.concatenate([np.max(x[i : i + 4096] @ chosen.T, 1) for i in range(0, len(x), 4096)]).clip(0, 1)
    return x * (1 - like * like)[:, None]


def _nominees(keys: list, x: np.ndarray, w: np.ndarray, most: int, tolerance: float) -> tuple[list, np.ndarray, np.ndarray]:
    order = np.asarray(sorted(range(len(keys)), key=keys.__getitem__), int)
    picks, _ = pivoted_rows(w[order], most, tolerance)
    picks = order[picks]
    return [keys[i] for i in picks], x[picks], w[picks]


def choose_varied(vectors: DataFrame, key: str, vector: str, k: int, tolerance: float = 0.3) -> DataFrame:
    """(key, rank): up to ``k`` records in the order in which they are chosen, so the first m are the subset of size m.

    ``vectors`` has one usable vector a key (not NULL). All records come out if there are fewer than k; records that are copies
    of chosen ones come last, by key. An empty table or k below 1 gives no rows. The chosen vectors, k at most, are what the
    driver holds and sends to the workers.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[key]
    if k < 1:
        return spark.createDataFrame([], f"`{key}` {kind}, rank int")
    kept = cut(vectors.select(key, vector))
    parts = max(1, kept.rdd.getNumPartitions())
    schema = f"`{key}` {kind}, x array<float>, w array<float>, part int"
    chosen_keys: list = []
    chosen = np.zeros((0, 0), np.float32)
    while len(chosen_keys) < k:
        shared = spark.sparkContext.broadcast((chosen, k - len(chosen_keys)))

        def nominate(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            chosen, wanted = shared.value
            keys: list = []
            x = w = None
            kind_of_key = None
            for batch in stream:
                if not batch.num_rows:
                    continue
                kind_of_key = batch.schema.field(0).type
                unit = matrix(batch.column(1)).astype(np.float32)
                small = _deflated(unit, chosen)
                if x is not None:
                    unit, small = np.concatenate([x, unit]), np.concatenate([w, small])
                keys, x, w = _nominees(keys + batch.column(0).to_pylist(), unit, small, min(wanted, unit.shape[1]), tolerance)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, kind_of_key), float_lists(x), float_lists(w), pa.array([TaskContext.get().partitionId()] * len(keys), pa.int32())],
                    [key, "x", "w", "part"],
                )

        def play(table: pa.Table, shared=shared) -> pa.Table:
            """The nominees of some partitions, two sets at a time until one is left."""
            table = table.combine_chunks()
            wanted = shared.value[1]
            keys, part = table[key].to_pylist(), table["part"].to_numpy()
            x, w = (table[c].combine_chunks().flatten().to_numpy().reshape(len(keys), -1) for c in ("x", "w"))
            sets = [([keys[i] for i in rows], x[rows], w[rows]) for p in np.unique(part) for rows in [np.flatnonzero(part == p)]]
            while len(sets) > 1 or sets[0][1].shape[0] > sets[0][1].shape[1]:
                pairs = [sets[i : i + 2] for i in range(0, len(sets), 2)]
                sets = [_nominees(sum((s[0] for s in p), []), *(np.concatenate([s[i] for s in p]) for i in (1, 2)), min(wanted, x.shape[1]), tolerance) for p in pairs]
            keys, x, w = sets[0]
            return pa.table({key: pa.array(keys, table.schema.field(key).type), "x": float_lists(x), "w": float_lists(w), "part": pa.array([int(part.min()) // FAN_IN] * len(keys), pa.int32())})

        nominees = kept.mapInArrow(nominate, schema)
        level = parts
        while True:
            nominees = nominees.groupBy((F.col("part") / FAN_IN).cast("int").alias("heat")).applyInArrow(lambda t: play(t), schema)
            if level <= FAN_IN:
                break
            level = -(-level // FAN_IN)
        last = nominees.toArrow()  # as many rows as a vector has elements, at most
        if not last.num_rows:
            break
        keys = last[key].to_pylist()
        x, w = (last[c].combine_chunks().flatten().to_numpy().reshape(len(keys), -1) for c in ("x", "w"))
        order = np.asarray(sorted(range(len(keys)), key=keys.__getitem__), int)
        picks, remainders = pivoted_rows(w[order], len(keys), tolerance)
        if not len(picks) or remainders[0] < 1e-3:
            break
        picks = order[picks][: k - len(chosen_keys)]
        chosen_keys += [keys[i] for i in picks]
        chosen = x[picks] if not len(chosen) else np.concatenate([chosen, x[picks]])
    ranked = spark.createDataFrame([(c, i + 1) for i, c in enumerate(chosen_keys)], f"`{key}` {kind}, rank int")
    if len(chosen_keys) >= k:
        return ranked
    # What is left is copies of chosen records: they fill up by key.
    rest = kept.select(key).join(ranked, key, "left_anti").orderBy(key).limit(k - len(chosen_keys)).toArrow()[key].to_pylist()
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(chosen_keys + rest)], f"`{key}` {kind}, rank int")
