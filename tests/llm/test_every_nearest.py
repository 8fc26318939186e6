from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanframe.llm.neighbours import every_nearest, exact_nearest, recall_against
from gleanframe.llm.similar import p5_neighbours, photo_vectors


@pytest.fixture(scope="module")
def spread(spark):
    """Rows without any order, near-alike rows whose cosines tie at six decimals, and copies."""
    rng = np.random.default_rng(3)
    alike = rng.standard_normal((1, 12)) + rng.standard_normal((150, 12)) * 3e-4
    x = np.concatenate([rng.standard_normal((700, 12)), alike, np.repeat(rng.standard_normal((1, 12)), 20, 0)]).astype(np.float32)
    keys = [f"p{i:04}" for i in rng.permutation(len(x))]
    table = pa.table({"photo_id": keys, "vector": pa.array(x.tolist(), pa.list_(pa.float32()))}).sort_by("photo_id")
    y = x[np.argsort(keys)].astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = np.round(np.clip(y @ y.T, -1, 1), 6)
    np.fill_diagonal(c, -2)
    near = np.argsort(-c, axis=1, kind="stable")[:, :5]
    names = sorted(keys)
    return spark.createDataFrame(table), [(names[i], names[j], rank + 1, c[i, j]) for i, row in enumerate(near) for rank, j in enumerate(row)]


@pytest.mark.parametrize("block_rows", [1 << 14, 200, 30])
def test_every_nearest_equals_all_pairs(spread, block_rows):
    df, expected = spread
    got = sorted((r["photo_id"], r["neighbour"], r["rank"], r["cosine"]) for r in every_nearest(df, "photo_id", "vector", 5, block_rows).collect())
    # A cosine on the edge of two roundings may fall to either side, depending on the order of the sum.
    assert sorted((a, rank) for a, _, rank, _ in got) == sorted((a, rank) for a, _, rank, _ in expected)
    cosines = {(a, rank): cosine for a, _, rank, cosine in expected}
    assert all(abs(cosines[a, rank] - cosine) <= 1.1e-6 for a, _, rank, cosine in got)
    assert len({g[:3] for g in got} ^ {e[:3] for e in expected}) <= 0.02 * len(expected)


def test_few_rows(spark):
    schema = "photo_id string, vector array<float>"
    assert every_nearest(spark.createDataFrame([], schema), "photo_id", "vector", 5).count() == 0
    assert every_nearest(spark.createDataFrame([("a", [1.0, 2.0])], schema), "photo_id", "vector", 5).count() == 0
    three = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [-1.0, 0.0])], schema)
    got = sorted((r["photo_id"], r["rank"], r["neighbour"]) for r in every_nearest(three, "photo_id", "vector", 5).collect())
    assert got == [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c"), ("c", 1, "a"), ("c", 2, "b")]


def test_far_neighbours_are_found(spark):
    """At this size there are several lists, and a third of the neighbours are below 0.85."""
    folder = "/root/testdata/sf0.1"
    vectors = photo_vectors(spark, folder)
    asked = vectors.where(F.pmod(F.xxhash64("photo_id"), F.lit(100)) == 0)
    exact = exact_nearest(vectors, asked, "photo_id", "vector", 5)
    found = recall_against(p5_neighbours(spark, folder), exact, "photo_id").first()
    assert found["pairs"] > 500 and found["recall"] == 1
