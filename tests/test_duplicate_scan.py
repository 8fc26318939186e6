from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import duplicates as d
from gleanframe.operators.duplicate_scan import cells_of_items, item_matches, scan_groups

SCHEMA = "item string, content string, bits bigint, number int"


def scan(spark, rows, distance):
    cells = cells_of_items(spark.createDataFrame(rows, SCHEMA), "item", "content", "bits", distance)
    groups = [tuple(r) for r in scan_groups(cells).orderBy("number").select("number", "group_id", "kind", "members", "exact_pairs", "similar_pairs", "min_distance").collect()]
    return groups, {r["item"]: tuple(r)[1:] for r in item_matches(cells).collect()}


def test_chain_is_one_group(spark):
    groups, matches = scan(spark, [("a", "x", 0, 0), ("b", "y", 1, 0), ("c", "z", 3, 0), ("d", "w", -1, 0)], 1)
    assert groups == [(1, "a", "similar", 3, 0, 2, 1)]
    assert matches["a"] == (0, 1, 1, "hamming", 1, "b") and matches["b"] == (0, 2, 1, "hamming", 1, "a") and "d" not in matches


def test_kinds_and_missing_prints(spark):
    rows = [("a", "x", 0, 0), ("b", "x", None, 0), ("c", "y", 1, 0), ("d", None, 1, 0), ("e", "v", None, 0), ("f", "v", None, 0), (None, "x", 0, 0), ("g", None, None, 0)]
    groups, matches = scan(spark, rows, 1)
    # c and d differ in nothing but aren't of one known content: similar at 0
    assert groups == [(1, "e", "exact", 2, 1, 0, None), (2, "a", "mixed", 4, 1, 3, 0)]
    assert matches["a"] == (1, 2, 1, "exact", 0, "b") and matches["c"] == (0, 2, 0, "hamming", 0, "d") and "g" not in matches
    assert scan(spark, [], 8) == ([], {})


def test_copies_of_one_content_are_no_similar_peers(spark):
    rows = [("a", "x", 0, 0), ("b", "x", 1, 0), ("c", "x", 0, 0), ("d", "y", 3, 0)]
    groups, matches = scan(spark, rows, 2)
    assert groups == [(1, "a", "mixed", 4, 3, 3, 1)]
    assert matches["d"] == (0, 3, 1, "hamming", 1, "b") and matches["c"] == (2, 1, 2, "exact", 0, "a")


@pytest.mark.parametrize("distance", [8, 20, 64])
def test_links_of_any_distance(spark, monkeypatch, distance):
    import random

    monkeypatch.setattr(d, "BLOCK", 40)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(12))) for b in base for _ in range(8)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "k int, h bigint")
    got = {tuple(r) for r in d.hamming_links(df, "k", "h", distance).collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(i, j, apart(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and apart(a, b) <= distance}
    assert d.hamming_links(df.where(F.col("k") < 0), "k", "h", distance).count() == 0
