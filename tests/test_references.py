from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanframe.functions.ids import clean_id, integer_key
from gleanframe.operators.references import BUCKET, Reference, key_runs, live_parents, orphan_references

DAY = [datetime(2024, 1, d) for d in range(1, 20)]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_integer_key_is_injective(spark):
    ids = ["a_0000000000ff", "a_ff", "ff", "a_7", "a_07", "7", "07", "0", "", "a_0", "x", "h:", "b_0000000000ff", "1" * 11, "1" * 12, "1" * 30]
    df = spark.createDataFrame([(i,) for i in ids], "k string")
    space, number = integer_key(F.col("k"))
    assert df.select(space, number).distinct().count() == len(ids)


def test_clean_id(spark):
    df = spark.createDataFrame([(" Ab ",), ("",), ("  ",), (None,), ("\tx\n",)], "k string")
    assert [r[0] for r in df.select(clean_id("k")).collect()] == ["ab", None, None, None, "x"]


def test_runs_are_contiguous_and_cut_at_buckets(spark):
    keys = [f"{i}" for i in [1, 2, 3, 7, 8, BUCKET - 1, BUCKET]]
    parents = rows(spark, [("t", k, DAY[0]) for k in keys], "target string, ref_key string, created_at timestamp_ntz")
    runs = sorted((r["first"], r["last"]) for r in key_runs(parents).collect())
    assert runs == [(1, 3), (7, 8), (BUCKET - 1, BUCKET - 1), (BUCKET, BUCKET)]


@pytest.fixture
def found(spark):
    def run(refs, parents, removed):
        r = rows(spark, refs, "rec string, ref string, at timestamp_ntz, target string")
        p = rows(spark, parents, "id string, created timestamp_ntz, ref_key string")
        gone = rows(spark, removed, "table_name string, key_value string, removed_at timestamp_ntz")
        got = orphan_references([Reference("r", r, "rec", "ref", "at", "t")], [live_parents("t", p, "id", "created", gone)])
        return sorted(map(tuple, got.collect()), key=repr)

    return run


def test_cases(found):
    parents = [(f"{i}", DAY[5], "clash") for i in range(1, 9)] + [("n_1", None, ""), ("Late ", DAY[9], None), (None, DAY[1], None), (" ", DAY[1], None)]
    removed = [("t", "3", DAY[5]), ("t", "4", DAY[2]), ("other", "5", DAY[9]), ("T ", " 6 ", DAY[9]), ("t", None, DAY[9]), ("t", "n_1", DAY[1])]
    refs = [
        ("a", "1", DAY[6], "x"), ("a", "1", DAY[6], "x"), ("b", "3", DAY[6], "x"), ("c", "4", DAY[6], "x"), ("d", "5", DAY[6], "x"),
        ("e", "6", DAY[6], "x"), ("f", "7", DAY[4], "x"), ("g", "8", None, "x"), ("h", "99", None, "x"), ("i", None, DAY[6], "x"), ("j", "  ", DAY[6], "x"),
        ("k", "LATE", DAY[8], "x"), (None, "nobody", DAY[8], "x"), ("l", "n_1", DAY[8], "x"), ("m", "7", DAY[6], "x"),
    ]
    assert found(refs, parents, removed) == sorted([
        ("r", "b", "3", "2024-01"), ("r", "e", "6", "2024-01"), ("r", "f", "7", "2024-01"), ("r", "h", "99", "unknown"),
        ("r", "k", "late", "2024-01"), ("r", None, "nobody", "2024-01"), ("r", "l", "n_1", "2024-01"),
    ], key=repr)


def test_empty_tables(found):
    assert found([], [("1", DAY[1], "")], []) == []
    assert found([("a", "1", DAY[2], "")], [], []) == [("r", "a", "1", "2024-01")]


def test_hot_key(found):
    refs = [(f"r{i}", "hot", DAY[3], "") for i in range(500)] + [("z", "1", DAY[3], "")]
    assert len(found(refs, [("1", DAY[1], "")], [])) == 500
