from __future__ import annotations

import random

from gleanframe.llm.consolidation import consolidate, group_sizes


def brute(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a string, b string, id string")
    return dict(map(tuple, consolidate(df, "a", "b").collect()))


def shapes(rng):
    name = lambda k, i: f"{k}{i:03}"
    yield from [(name("path", rng.sample(range(70), 70)[0] * 0 + i), name("path", i + 1)) for i in range(70)]
    yield from [(name("ring", i), name("ring", (i + 1) % 41)) for i in range(41)]
    yield from [(name("star", 0), name("star", i)) for i in range(1, 90)]
    yield from [(name("full", i), name("full", j)) for i in range(7) for j in range(i)]
    yield from [("lone1", "lone2"), ("tri1", "tri2"), ("tri2", "tri3"), ("tri3", "tri1")]
    yield from [(name("tree", i), name("tree", (i - 1) // 2)) for i in range(1, 63)]
    # two cliques joined by a long chain with a leaf, and a loop hanging on one vertex
    yield from [(name("k", i), name("k", j)) for i in range(5) for j in range(i)] + [(name("m", i), name("m", j)) for i in range(5) for j in range(i)]
    yield from [("k000", "c00"), *((f"c{i:02}", f"c{i + 1:02}") for i in range(20)), ("c20", "m000"), ("c07", "leaf")]
    yield from [("m004", "l0"), ("l0", "l1"), ("l1", "l2"), ("l2", "m004")]


def test_shapes(spark):
    rng = random.Random(4)
    pairs = list(shapes(rng))
    rng.shuffle(pairs)
    pairs = [p if rng.random() < 0.5 else p[::-1] for p in pairs]
    assert run(spark, pairs) == brute(pairs)


def test_random_graphs_and_dirt(spark):
    rng = random.Random(5)
    pairs = [(f"v{rng.randrange(300)}", f"v{rng.randrange(300)}") for _ in range(230)]
    dirty = [*pairs, *pairs[:20], *((b, a) for a, b in pairs[:20]), ("v1", None), (None, None), ("self", "self")]
    got = run(spark, dirty)
    assert got == brute([p for p in pairs if p[0] != p[1]])
    assert "self" not in got


def test_empty(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert consolidate(empty, "a", "b").count() == 0
    assert group_sizes(consolidate(empty, "a", "b")).count() == 0


def test_colliding_hashes(spark, monkeypatch):
    """Where two ids have one hash, ids are numbered instead."""
    from pyspark.sql import functions as F

    from gleanframe.llm import consolidation

    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("p", "q")]
    monkeypatch.setattr(consolidation, "vertex", lambda column: F.length(column).cast("bigint"))
    assert run(spark, pairs) == brute(pairs)
