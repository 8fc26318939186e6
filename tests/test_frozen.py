from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.functions.images import convex, difference_hash
from gleanframe.functions.names import key_of, latin_query, name_of
from gleanframe.operators import snapshots as sn
from gleanframe.operators.ordering import running_total
from gleanframe.operators.pairs import exact_subgroups, group_digest, pair_page
from gleanframe.operators.snapshots import Stale
from gleanframe.operators.trigrams import open_index, save_index, search, trigrams
from gleanframe.plans.extractors import Extractor, Registry


def test_pair_pages_equal_all_pairs(spark):
    rng = random.Random(8)
    members = sorted({(f"g{rng.randrange(9)}", rng.randrange(60)) for _ in range(90)})
    every = [(g, a, b) for i, (g, a) in enumerate(members) for h, b in members[i + 1 :] if g == h]
    df = spark.createDataFrame(members, "g string, i int").repartition(3)
    for after, size in ((0, 7), (30, 50), (len(every) - 3, 10), (len(every), 5)):
        got = [tuple(r) for r in pair_page(df, "g", "i", after, size).orderBy("pair_no").collect()]
        assert got == [(after + 1 + n, *x) for n, x in enumerate(every[after : after + size])]
    assert pair_page(df.limit(0), "g", "i", 0, 5).count() == 0


def test_running_total(spark):
    df = spark.range(0, 200, 1, 6).withColumn("n", F.col("id") % 7)
    got = [r["before"] for r in running_total(df, [F.col("id")], "n").orderBy("id").collect()]
    assert got == [sum(i % 7 for i in range(k)) for k in range(200)]


def test_snapshots(spark):
    rows = spark.createDataFrame([(i, f"x{i}", None) for i in range(1, 8)], "number int, item string, note string")
    sealed = sn.digest(rows)
    assert sealed == sn.digest(rows.repartition(5)) != sn.digest(rows.limit(6)) and sealed != sn.digest(rows.unionByName(rows.limit(1)))
    first, at = sn.page(rows, sealed, None, 3)
    second, _ = sn.page(rows, sealed, at, 3)
    assert [r["number"] for r in first.collect()] == [1, 2, 3] and [r["number"] for r in second.collect()] == [4, 5, 6]
    with pytest.raises(sn.Stale):
        sn.page(rows, "other", at, 3)
    assert sn.selected(rows, [2, 5], sealed, sealed).count() == 2 and sn.selected(rows, [], sealed, sealed).count() == 0
    for numbers, reviewed, error in (([9], sealed, ValueError), ([2, 2], sealed, ValueError), ([1], "other", sn.Stale)):
        with pytest.raises(error):
            sn.selected(rows, numbers, sealed, reviewed)
    now = spark.createDataFrame([("x1", None), ("x2", "new")], "item string, note string")
    assert sorted(r[0] for r in sn.stale_rows(rows.where("number <= 3"), now, "item", ["note"]).collect()) == ["x2", "x3"]
    decided = spark.createDataFrame([(0,), (2,)], "page int")
    assert [r[0] for r in sn.undecided_pages(rows, decided, 3).collect()] == [1]


def test_trigrams(spark):
    texts = ["the market stall", "stall market", None, "", "st", "100% sure", "Straße", "a\nb%c", "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    index = trigrams(df, "k", "t")
    for literal in ("stall", "st", "%", "0% s", "aße", "xxxx", "none", "\nb%"):
        got = sorted(r[0] for r in search(index, df, "k", "t", literal).collect())
        assert got == [i for i, t in enumerate(texts) if t is not None and literal in t]


def test_saved_trigrams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} stall") for i in range(30)] + [(99, None)], "k int, t string")
    save_index(df, "k", "t", str(tmp_path / "index"))
    index = open_index(spark, str(tmp_path / "index"), "k", verify=True)
    assert sorted(r[0] for r in search(index, df, "k", "t", "text 2").collect()) == [2, *range(20, 30)]
    spark.createDataFrame([("abc", 5, 3)], "gram string, k int, bucket int").write.partitionBy("bucket").mode("append").parquet(str(tmp_path / "index" / "grams"))
    with pytest.raises(Stale):
        open_index(spark, str(tmp_path / "index"), "k", verify=True)


def test_components_digest(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "v bigint, label bigint")
    one = dict(map(tuple, group_digest(labels, "d=8").collect()))
    assert one == dict(map(tuple, group_digest(labels.repartition(4), "d=8").collect())) and one[1] != one[3]
    assert one != dict(map(tuple, group_digest(labels, "d=4").collect()))
    content = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "k bigint, c string")
    assert [tuple(r) for r in exact_subgroups(labels, content, "k", "c").collect()] == [(1, "a", 2)]


def test_pictures(spark):
    grid = [0.0] * 72
    first = list(grid)
    first[0] = 1.0
    last = list(grid)
    last[70] = 1.0
    df = spark.createDataFrame([(first,), (last,), (grid,), (grid[:71],)], "g array<double>")
    # the last bright pixel is greater than its right neighbour only
    assert [r[0] for r in df.select(difference_hash(F.col("g"))).collect()] == [-(2**63), 1, 0, None]
    quads = [([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], True), ([[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0]], False), ([[0.0, 0.0]], False)]
    df = spark.createDataFrame(quads, "q array<array<double>>, ok boolean")
    assert all(r[0] == r[1] for r in df.select(convex(F.col("q")), "ok").collect())


def test_names():
    assert name_of("  Café ") == "Café" and key_of("STRASSE") == key_of("Straße") and name_of(" ") is None and name_of("a\x00") is None
    assert latin_query(" crème ") == "crème"
    assert latin_query("a\u200bb") == "a\u200bb"  # the reference lets format characters through
    assert latin_query("море", "the sea") == "the sea"
    for bad in ("", "море", "a\x00b", "x" * 4097):
        with pytest.raises(ValueError):
            latin_query(bad)
    with pytest.raises(ValueError):
        latin_query("sea", " ")


def test_extractors_compute_once(spark):
    registry = Registry()
    profile = registry.register(Extractor("length", {"v": 1}, "item string, input string, n bigint", lambda b: pd.DataFrame({"item": b["item"], "input": b["input"], "n": b["input"].str.len()})))
    assert profile == registry.register(Extractor("length", {"v": 1}, "item string, input string, n bigint", len))
    plan = spark.createDataFrame([("a", "xx", "compute"), ("b", "y", "reuse"), ("c", "zzz", "compute")], "item string, input string, action string")
    done = spark.createDataFrame([("c", "zzz", 3)], "item string, input string, n bigint")
    assert [tuple(r) for r in registry.execute(profile, plan, done, ["item", "input"]).collect()] == [("a", "xx", 2)]
