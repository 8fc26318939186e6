from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanframe.functions.dates import saved_date
from gleanframe.functions.text import escaped, leading_blocks, size_label
from gleanframe.operators import scopes as sc
from gleanframe.operators import versions as v
from gleanframe.operators.geometry import composition
from gleanframe.operators.ordering import average_rank_percentile, keyset_page, monotone_times
from gleanframe.operators.reviews import attempt_totals


def test_percentiles_by_direction(spark):
    rows = [("up", "a", -0.9), ("up", "b", -0.3), ("up", "c", -0.3), ("up", "d", 0.4), ("low", "a", 16.0), ("low", "b", 8.0), ("low", "c", 8.0), ("low", "d", 0.0), ("yes", "a", 1.0), ("yes", "b", 2.0), ("one", "a", 5.0)]
    df = spark.createDataFrame(rows, "g string, k string, x double")
    found = average_rank_percentile(df, "g", "k", "x", lower=F.col("g") == "low", exact=F.col("g") == "yes").orderBy("g", "k").collect()
    got = {}
    for r in found:
        got.setdefault(r["g"], []).append(r["normalized"])
    assert got == {"up": [0, 0.5, 0.5, 1], "low": [0, 0.5, 0.5, 1], "yes": [1, 1], "one": [1]}
    assert average_rank_percentile(df.limit(0), "g", "k", "x").count() == 0


def test_page_sizes(spark):
    for bad in (0, 1001, True, 1.5):
        with pytest.raises(ValueError):
            keyset_page(spark.range(3), "id", None, bad)
    assert keyset_page(spark.range(3), "id", None, 1000).count() == 3


def test_strict_times(spark):
    t = dt.datetime(2024, 1, 1)
    us = dt.timedelta(microseconds=1)
    times = [t, t, t + us, t, t + 5 * us, t + 5 * us]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(times)], "g int, k int, x timestamp")
    got = [r["stamp"] for r in monotone_times(df, "g", [F.col("k")], "x").orderBy("k").collect()]
    want, last = [], None
    for x in times:
        last = x if last is None or x > last else last + us
        want.append(last)
    assert got == want


def test_dates_of_metadata(spark):
    cases = [
        ("error", "{}", "metadata_unavailable"), (None, "{}", "metadata_unavailable"), ("available", None, "missing_datetime_original"), ("available", "not json", "missing_datetime_original"),
        ("available", '{"exif": []}', "invalid_exif_type"), ("available", '{"exif": null}', "missing_datetime_original"), ("available", '{"exif": {}}', "missing_datetime_original"),
        ("available", '{"exif": {"datetime_original": ""}}', "missing_datetime_original"), ("available", '{"exif": {"datetime_original": 5}}', "invalid_datetime_original_type"),
        ("available", '{"exif": {"datetime_original": "2024-01-01 00:00:00"}}', "invalid_datetime_original_format"), ("available", '{"exif": {"datetime_original": "2023:02:29 00:00:00"}}', "invalid_datetime_original_value"),
        ("available", '{"exif": {"datetime_original": "2024:02:29 23:59:59"}}', None),
    ]
    text, reason = saved_date(F.col("state"), F.col("m"))
    got = spark.createDataFrame([(i, s, m) for i, (s, m, _) in enumerate(cases)], "i int, state string, m string").select("i", reason.alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [c[2] for c in cases]


def test_labels_and_blocks(spark):
    df = spark.createDataFrame([(0, None), (1023, "a<b"), (1 << 20, "\"'&"), (-1, ""), (None, "x")], "n bigint, t string")
    assert [r[0] for r in df.select(size_label(F.col("n"))).collect()] == ["0.0 KB", "1.0 KB", "1.00 MB", "未知", "未知"]
    assert [r[0] for r in df.select(escaped(F.col("t"))).collect()] == [None, "a&lt;b", "&quot;&#x27;&amp;", "", "x"]
    blocks = spark.createDataFrame([(["aa", "bb", "cc"],), ([],), (["x" * 9, "a"],)], "b array<string>")
    assert [r[0] for r in blocks.select(leading_blocks(F.col("b"), 5, 5)).collect()] == [["aa", "bb"], [], []]
    assert [r[0] for r in blocks.select(leading_blocks(F.col("b"), 1, 50)).collect()] == [["aa"], [], ["x" * 9]]


def test_composition(spark):
    box = lambda *b: {"score": 0.5, "box": list(map(float, b))}
    df = spark.createDataFrame([([box(0, 0, 0.5, 0.5), box(0.25, 0.25, 0.75, 0.75)],), ([],), ([box(0, 0, 2, 2)],)], "o array<struct<score:double,box:array<double>>>")
    rows = [r["c"] for r in df.select(composition(F.col("o")).alias("c")).collect()]
    assert rows[0]["union_area"] == pytest.approx(0.4375) and rows[0]["bounding_area"] == pytest.approx(0.5625) and rows[0]["subject_index"] == 0 and rows[0]["center_x"] == 0.25
    assert rows[1]["union_area"] == 0 and rows[1]["uncovered_fraction"] == 1 and rows[1]["subject_index"] is None
    assert rows[2]["union_area"] == 1 and rows[2]["uncovered_fraction"] == 0


def test_folder_changes(spark):
    folders = spark.createDataFrame([("f1", "Sea", "sea"), ("f2", "Sky", "sky")], "folder_id string, name string, name_key string")
    members = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "b")], "folder_id string, item string")
    assert sc.create_folder(folders, "f3", "Wood", "wood").count() == 3
    for refused in (lambda: sc.create_folder(folders, "f3", "SEA", "sea"), lambda: sc.rename_folder(folders, "f1", "sky", "sky"), lambda: sc.rename_folder(folders, "f9", "x", "x")):
        with pytest.raises(ValueError):
            refused()
    renamed, counts = sc.rename_folder(folders, "f1", "SEA", "sea")
    assert counts == {"renamed": 1, "unchanged": 0} and {r["name"] for r in renamed.collect()} == {"SEA", "Sky"}
    assert sc.rename_folder(folders, "f1", "Sea", "sea")[1] == {"renamed": 0, "unchanged": 1}
    left, kept, gone = sc.delete_folder(folders, members, "f1")
    assert left.count() == 1 and kept.count() == 1 and tuple(gone.first()) == (1, 2)
    asked = spark.createDataFrame([("b",), ("b",), ("z",)], "item string")
    assert tuple(sc.removal_counts(members, "f1", asked).first()) == (3, 2, 1, 1, 1)
    assert sorted(map(tuple, sc.without_items(members, "f1", asked).collect())) == [("f1", "a"), ("f2", "b")]
    lists = spark.createDataFrame([("g", "y", 1), ("g", "x", 2), ("g", "y", 3), ("g", None, 0)], "g string, item string, at int")
    assert sorted(map(tuple, sc.first_positions(lists, "g", "item", "at").select("item", "place").collect())) == [("x", 2), ("y", 1)]


def test_dependencies_and_attempts(spark):
    results = spark.createDataFrame([(f"r{i}", item, source, "c1", h) for i, (item, source, h) in enumerate([("p", "s1", "h1"), ("p", "s9", "h1"), ("p", "s2", "h2"), ("p", "s3", "h3"), ("q", "s1", "h1"), ("p", "s1", "old"), (None, None, None)])], "result_id string, item string, source_id string, c string, h string")
    items = spark.createDataFrame([("p", True, "c1"), ("q", False, "c1")], "item string, usable boolean, c string")
    sources = spark.createDataFrame([("s1", True, "c1", "h1"), ("s2", False, "c1", "h2"), ("s3", True, "c0", "h3")], "source_id string, valid boolean, c string, h string")
    got = {r["result_id"]: (r["coverage"], r["upstream"]) for r in v.dependency_coverage(results, items, sources, ["c"], ["h"]).collect()}
    assert got == {
        "r0": ("ready", None), "r1": ("dependency_missing", "missing"), "r2": ("dependency_missing", "invalid_vector"), "r3": ("dependency_missing", "stale"),
        "r4": ("invalid_input", None), "r5": ("stale", None), "r6": ("invalid_input", None),
    }
    rows = spark.createDataFrame([("b", 1, 1, 5), ("b", 1, 2, 7), ("b", 2, 1, None), ("c", 1, 1, 3)], "b string, a int, n int, x bigint")
    totals = {r["batch"]: tuple(r)[1:] for r in attempt_totals(rows, "b", "a", [F.col("n")], F.col("x")).collect()}
    assert totals == {"b": (2, 1, 7, False), "c": (1, 1, 3, True)}
    now = spark.createDataFrame([("a", "v", True), ("b", "v", False)], "k string, v string, bad boolean")
    changes = dict(map(tuple, v.scan_diff(now.limit(0), now, "k", "v", failed="bad").collect()))
    assert changes == {"a": "failed", "b": "added"}
