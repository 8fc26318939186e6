from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanframe.functions.responses import strict, strict_json
from gleanframe.sources import files


def test_pictures(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    for name in ("a/x.jpg", "a/y.PNG", "a/z.txt", "a/skip/w.tif"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.pictures(spark, str(tmp_path), ("skip",))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["x.jpg", "y.PNG"]
    read = files.contents(spark, str(tmp_path), found)
    assert read.count() == 2 and read.where("length(content_version) = 64").count() == 2
    assert files.unchanged(found, found.withColumn("modified", F.when(F.endswith("path", F.lit("jpg")), F.col("modified")).otherwise(F.lit(datetime(2000, 1, 1))))).count() == 1


def test_publish_and_backup(spark, tmp_path):
    path = str(tmp_path / "x.json")
    files.publish({"a": "ß"}, path)
    assert files.read_document(path) == {"a": "ß"}
    with pytest.raises(FileExistsError):
        files.publish({}, path)
    assert files.backup({"t": spark.range(5)}, str(tmp_path / "copy")) == {"t": 5}
    with pytest.raises(Exception):
        files.backup({"t": spark.range(5)}, str(tmp_path / "copy"))


def test_located(spark):
    photos = spark.createDataFrame([("a", "/x/1", None), ("b", "/gone", "2"), ("c", None, None), ("d", "/gone2", "no"), ("e", "/x/3", None), ("f", "/nope", "3")], "photo_id string, original_absolute_path string, original_relative_path string")
    there = spark.createDataFrame([("/x/1",), ("/x/2",), ("/x/3",)], "path string")
    got = {r["photo_id"]: (r["path"], r["original_status"]) for r in files.located(photos, there, "/x/").collect()}
    assert got == {"a": ("/x/1", "available"), "b": ("/x/2", "available"), "c": (None, "not_checked"), "d": (None, "missing"), "e": ("/x/3", "conflict"), "f": ("/x/3", "conflict")}


def test_strict_answers(spark):
    assert strict('```json\n{"b": 1, "a": [2]}\n```') == '{"a":[2],"b":1}' == strict('{"b":1,"a":[2]}')
    for bad in ('{"a":1,"a":2}', "NaN", '{"a":', "x ```json\n{}\n```", None, '"' + "x" * (1 << 20) + '"', "[" * 100000):
        assert strict(bad) is None
    df = spark.createDataFrame([("[1]",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(strict_json("t")).collect()] == ["[1]", None, None]
