from __future__ import annotations

import numpy as np
import pytest

from gleanframe.llm.clustering import ClusterSettings, FeatureTree, cluster_vectors, describe_clusters, exact_clusters, ward
from gleanframe.llm.neighbours import IndexSettings, exact_nearest, nearest_vectors, recall_against, top_columns
from gleanframe.llm.subset import choose_varied, pivoted_rows
from gleanframe.llm.vectors import CentroidGraph, balanced_centres, current_vectors, separated

SMALL = IndexSettings(list_rows=40, group_lists=2, sample_rows=8, unit_rows=60, block_rows=50, ratio=1.4, overlap=1.4)


def album(seed=0, d=16):
    """Groups of near-alike rows, a mass, exact copies and singles."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    parts = [unit(unit(rng.standard_normal(d)) + rng.standard_normal((n, d)) * 0.04) for n in (150, 30, 12, 7, 5, 4, 2)]
    x = np.concatenate([*parts, np.repeat(unit(rng.standard_normal((1, d))), 9, 0), unit(rng.standard_normal((60, d)))])
    return [f"p{i:04}" for i in rng.permutation(len(x))], (x * rng.uniform(0.2, 5, (len(x), 1))).astype(np.float32)


@pytest.fixture(scope="module")
def photos(spark):
    keys, x = album()
    df = spark.createDataFrame([(k, v.tolist(), "z") for k, v in zip(keys, x)], "photo_id string, vector array<float>, list string")
    order = np.argsort(keys)
    y = x[order].astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return df.repartition(5), sorted(keys), np.round(np.clip(y @ y.T, -1, 1), 6)


def brute_nearest(keys, c, k, least):
    c = c.copy()
    np.fill_diagonal(c, -2)
    out = set()
    for i, row in enumerate(c):
        for j in np.argsort(-row, kind="stable")[:k]:
            if row[j] >= least:
                out.add((keys[i], keys[j]))
    return out


def test_nearest_over_one_list_is_exact(photos):
    df, keys, c = photos
    got = {(r["photo_id"], r["neighbour"]) for r in nearest_vectors(df, "photo_id", "vector", 5, 0.85).collect()}
    assert got == brute_nearest(keys, c, 5, 0.85)


def test_nearest_over_many_lists_and_blocks(photos):
    df, keys, c = photos
    got = {(r["photo_id"], r["neighbour"]) for r in nearest_vectors(df, "photo_id", "vector", 5, 0.85, SMALL).collect()}
    true = brute_nearest(keys, c, 5, 0.85)
    assert len(got & true) / len(true) > 0.9
    exact = exact_nearest(df, df, "photo_id", "vector", 5)
    assert {(r["photo_id"], r["neighbour"]) for r in exact.collect()} == brute_nearest(keys, c, 5, -2)
    assert recall_against(exact, exact, "photo_id").first()["recall"] == 1


def test_nearest_of_few(spark):
    schema = "photo_id string, vector array<float>"
    assert nearest_vectors(spark.createDataFrame([], schema), "photo_id", "vector", 5).count() == 0
    one = spark.createDataFrame([("a", [1.0, 0.0])], schema)
    assert nearest_vectors(one, "photo_id", "vector", 5).count() == 0
    copies = spark.createDataFrame([(f"c{i}", [1.0, 2.0]) for i in range(9)], schema)
    got = sorted((r["photo_id"], r["rank"], r["neighbour"]) for r in nearest_vectors(copies, "photo_id", "vector", 3).collect())
    assert got[:3] == [("c0", 1, "c1"), ("c0", 2, "c2"), ("c0", 3, "c3")] and got[-1] == ("c8", 3, "c2")


def test_crowds_of_copies(spark):
    """A vector with many copies, with near ones around it: the copies beyond the first few are not compared."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    rows = [(f"c{i:03}", base.tolist()) for i in rng.permutation(120)] + [(f"{'an'[i % 2]}{i:02}", (base + rng.standard_normal(8) * 0.03).tolist()) for i in range(12)]
    rows += [(f"x{i}", rng.standard_normal(8).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "photo_id string, vector array<float>")
    keys = sorted(k for k, _ in rows)
    x = np.asarray([np.asarray(v, np.float32) for _, v in sorted(rows)], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(np.clip(x @ x.T, -1, 1), 6)
    got = {(r["photo_id"], r["neighbour"]) for r in nearest_vectors(df, "photo_id", "vector", 4, 0.85).collect()}
    assert got == brute_nearest(keys, c, 4, 0.85)
    found = {(r["photo_id"], r["cluster_id"]) for r in cluster_vectors(df, "photo_id", "vector", 0.85, 5).collect()}
    assert found == brute_clusters(keys, c, 0.85, 5) and len(found) >= 120


def brute_clusters(keys, c, limit, least):
    near = [frozenset(np.flatnonzero((row >= limit) | (np.arange(len(row)) == i))) for i, row in enumerate(c)]
    return {(keys[i], keys[min(n)]) for i, n in enumerate(near) if len(n) >= least and all(near[j] == n for j in n)}


@pytest.mark.parametrize("settings", [ClusterSettings(), ClusterSettings(fan=3, most_leaves=20, leaf_ratio=1.4, spread=2, index=SMALL)])
def test_clusters_equal_brute_force(photos, settings):
    df, keys, c = photos
    true = brute_clusters(keys, c, 0.85, 5)
    got = cluster_vectors(df, "photo_id", "vector", 0.85, 5, settings)
    found = {(r["photo_id"], r["cluster_id"]) for r in got.collect()}
    assert found <= true
    assert len(found) >= (len(true) if settings == ClusterSettings() else 0.8 * len(true))
    described = {r["cluster_id"]: (r["size"], r["typical"]) for r in describe_clusters(got, "photo_id").collect()}
    assert sum(n for n, _ in described.values()) == len(found) and all(len(t) == 3 for _, t in described.values())


def test_chains_and_bridges_are_no_clusters(spark):
    angle = lambda a: [float(np.cos(a)), float(np.sin(a))]
    chain = [(f"a{i}", angle(0.15 * i)) for i in range(8)]  # ends are further apart than the limit
    tight = [(f"b{i}", angle(3 + 0.01 * i)) for i in range(6)]
    df = spark.createDataFrame(chain + tight, "photo_id string, vector array<float>")
    got = {r["cluster_id"] for r in cluster_vectors(df, "photo_id", "vector", 0.85, 5).collect()}
    assert got == {"b0"}
    # c reaches the limit (0.5548) with the last of them only
    near = spark.createDataFrame(tight + [("c", angle(3.58))], "photo_id string, vector array<float>")
    assert cluster_vectors(near, "photo_id", "vector", 0.85, 5).count() == 0
    assert cluster_vectors(df.limit(0), "photo_id", "vector", 0.85, 5).count() == 0


def test_feature_tree_keeps_sums():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = FeatureTree(5, 0.9, 4)
    for v in x[:100]:
        tree.add(v)
    tree.add_all(x[100:250])
    tree.add_all(x[250:])
    sums, counts = tree.features()
    assert counts.sum() == 400 and np.allclose(sums.sum(0), x.sum(0)) and len(counts) == tree.leaves
    owner = ward(sums / counts[:, None], counts, 0.9)
    assert all(owner[o] == o for o in owner) and len(set(owner)) <= len(counts)


def test_graph_search_and_top_columns():
    rng = np.random.default_rng(1)
    c = rng.standard_normal((300, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = rng.standard_normal((200, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, cosines = CentroidGraph.build(c).search(q, 10)
    assert (ids[:, 0] == (q @ c.T).argmax(1)).mean() > 0.9 and (np.diff(cosines, axis=1) <= 0).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids)
    ids, _ = CentroidGraph.build(c[:1]).search(q, 4)
    assert (ids[:, 0] == 0).all() and (ids[:, 1:] == -1).all()
    top = top_columns(np.array([[0.5, 0.9, 0.9, -2.0], [-2.0, -2.0, -2.0, -2.0]]), 3)
    assert top.tolist() == [[1, 2, 0], [-1, -1, -1]]
    rows = rng.standard_normal((5000, 8))
    many = balanced_centres(rows / np.linalg.norm(rows, axis=1, keepdims=True), 1500)
    assert 1200 < len(many) <= 1800 and np.isfinite(many).all()
    apart = separated(many, 0.95)
    assert (apart @ apart.T - 2 * np.eye(len(apart)) < 0.95).all() and ((many @ apart.T).max(1) > 0.95 - 1e-9).all()
    assert len(separated(np.array([[1.0, 0], [0.99, 0.14], [0, 1.0]]), 0.85)) == 2


def test_graph_search_goes_on_until_nothing_is_better():
    """Many centres without any structure, asked for from near and far: the hardest case for a graph."""
    rng = np.random.default_rng(5)
    c = rng.standard_normal((8192, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    graph = CentroidGraph.build(c)
    for noise in (0.08, 0.12):
        q = c[rng.integers(0, len(c), 400)] + noise * rng.standard_normal((400, 64))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        assert (graph.search(q, 8)[0][:, 0] == (q @ c.T).argmax(1)).mean() >= 0.98


def test_recall_over_hundreds_of_lists_in_groups(spark):
    """The production ratio and width, with lists so short that there are some 800 of them in 13 groups."""
    from gleanframe.llm.similar import photo_vectors
    from gleanframe.session import cut

    vectors = cut(photo_vectors(spark, "/root/testdata/sf0.1"))
    rows = vectors.orderBy("photo_id").collect()
    x = np.asarray([r["vector"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys, true = [r["photo_id"] for r in rows], set()
    for i in range(0, len(x), 2000):
        c = np.round(x[i : i + 2000] @ x.T, 6)
        c[np.arange(len(c)), np.arange(i, i + len(c))] = -2
        for r, col in enumerate(top_columns(c, 5)):
            true |= {(keys[i + r], keys[j]) for j in col if c[r, j] >= 0.85}
    settings = IndexSettings(list_rows=14, group_lists=64)
    got = {(r["photo_id"], r["neighbour"]) for r in nearest_vectors(vectors, "photo_id", "vector", 5, 0.85, settings).collect()}
    assert len(got & true) / len(true) >= 0.95


def test_exact_clusters_equal_brute_force(photos):
    df, keys, c = photos
    got = {(r["photo_id"], r["cluster_id"]) for r in exact_clusters(df, "photo_id", "vector", 0.85, 5, block_rows=50).collect()}
    assert got == brute_clusters(keys, c, 0.85, 5)


def test_cluster_recall(spark):
    from gleanframe.llm.clusters import p6_recall

    row = p6_recall(spark, "/root/testdata/sf0.1").first()
    assert row["recall"] >= 0.99 and row["wrong"] == 0


def test_subset(photos, spark):
    df, keys, c = photos
    rows = [r["photo_id"] for r in choose_varied(df, "photo_id", "vector", 20).orderBy("rank").collect()]
    at = [keys.index(k) for k in rows]
    pair = c[np.ix_(at, at)] - 2 * np.eye(len(at))
    assert len(set(rows)) == 20 and pair.max() < 0.85
    smaller = [r["photo_id"] for r in choose_varied(df, "photo_id", "vector", 7).orderBy("rank").collect()]
    assert len(smaller) == 7 and c[np.ix_(*2 * [[keys.index(k) for k in smaller]])].max(initial=-1, where=~np.eye(7, dtype=bool)) < 0.85
    assert sorted(r[0] for r in choose_varied(df.select("photo_id", "vector"), "photo_id", "vector", 10**4).select("photo_id").collect()) == keys
    assert choose_varied(df.limit(0), "photo_id", "vector", 5).count() == 0 and choose_varied(df, "photo_id", "vector", 0).count() == 0
    order, left = pivoted_rows(np.eye(4)[[0, 0, 1, 2]], 4, 0.1)
    assert order.tolist() == [0, 2, 3] and np.allclose(left, 1)


def test_current_vectors(spark):
    from datetime import datetime

    day = [datetime(2024, 1, i) for i in range(1, 9)]
    nan = float("nan")
    rows = [
        ("A", "P", "r1", [1.0, 0.0], day[1]), (" a", " p ", "r2", [0.0, 1.0], day[2]), ("a", "q", "r3", [1.0, 1.0], day[5]),
        ("b", "p", "r4", [1.0, 0.0], day[1]), ("b", "p", "r5", [0.0, 0.0], day[2]), ("c", "p", "r6", [nan, 1.0], day[1]),
        ("d", "p", "r7", [1.0], day[1]), ("e", "p", "r8", None, day[1]), ("f", "p", "r9", [1.0, None], day[1]), (None, "p", "r0", [1.0, 1.0], day[1]), ("g", "p", "s1", [1.0, 0.0], None),
    ]
    results = spark.createDataFrame(rows, "photo_id string, profile_id string, result_id string, vector array<float>, created_at timestamp_ntz")
    profiles = spark.createDataFrame([("P", 1, day[0]), ("q", 0, day[0])], "profile_id string, is_default int, created_at timestamp_ntz")
    got = {r["photo_id"]: list(r["vector"]) for r in current_vectors(results, profiles, 2).collect()}
    assert got == {"a": [0.0, 1.0], "g": [1.0, 0.0]}
    assert current_vectors(results, profiles.where("is_default = 0"), 2).count() == 0
