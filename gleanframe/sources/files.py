"""Files of an album: finding pictures, reading documents, publishing and copying results."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of pictures.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp")


def pictures(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, size_bytes, modified) of the pictures below a folder, without reading them. ``excluded``: folder names."""
    pattern = "*.{" + ",".join(x for s in SUFFIXES for x in (s, s.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    for name in excluded:
        rows = rows.where(~F.contains("path", F.lit(f"/{name}/")))
    return rows


def contents(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path, content_version, size_bytes): SHA-256 of pictures' bytes; of ``wanted`` (path) only, where it is given."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if wanted is not None:
        found = found.join(wanted.select("path"), "path", "left_semi")
    return found.select("path", F.sha2("content", 256).alias("content_version"), F.col("length").alias("size_bytes"))


def unchanged(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pictures whose size and time are as they were: their content needn't be read again."""
    return now.join(before.select("path", "size_bytes", "modified"), ["path", "size_bytes", "modified"], "left_semi")


def read_document(path: str):
    """A JSON document of the driver, with or without a byte order mark."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def publish(value, path: str) -> None:
    """A small JSON document in a new file, which is there whole or not at all; an existing file is an error."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, sort_keys=True)
        os.link(name, target)
    finally:
        os.unlink(name)


def backup(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each table in a new folder, and their rows in ``_manifest.json``, written last: without it the copy isn't whole."""
    rows = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
        rows[name] = df.sparkSession.read.parquet(f"{folder}/{name}.parquet").count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(rows, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/_manifest.json")
    return rows


def located(photos: DataFrame, there: DataFrame, root: str) -> DataFrame:
    """(photo_id, path, original_status): the absolute path if it is there, else the relative one below ``root``.

    Two photos that claim one file are conflicts; one without any path is not_checked.
    """
    relative = F.when(F.col("original_relative_path").isNotNull(), F.concat_ws("/", F.lit(root.rstrip("/")), "original_relative_path"))
    tried = photos.select("photo_id", F.posexplode(F.array("original_absolute_path", relative)).alias("turn", "path"))
    hit = tried.join(there.select("path").distinct(), "path").groupBy("photo_id").agg(F.min_by("path", "turn").alias("path"))
    claims = hit.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    known = photos.select("photo_id", F.coalesce("original_absolute_path", relative).isNotNull().alias("_known"))
    found = known.join(hit.join(claims, "path"), "photo_id", "left")
    status = F.when(~F.col("_known"), "not_checked").when(F.col("path").isNull(), "missing").when(F.col("_n") > 1, "conflict").otherwise("available")
    return found.select("photo_id", "path", status.alias("original_status"))
