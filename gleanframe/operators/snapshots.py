"""Frozen results: sealed by a digest of their rows, read page by page, decided on, and rechecked against what is current."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Stale(ValueError):
    """The cursor, selection or snapshot doesn't belong to this content."""


def digest(rows: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or partitions."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    sums = rows.select(text.alias("t")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(i), "t").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2, 3))
    )
    return sums.select(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n", "s1", "s2", "s3"))), 256)).first()[0]


def cursor(sealed: str, number: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([sealed, number]).encode()).decode()


def page(rows: DataFrame, sealed: str, at: str | None, size: int) -> tuple[DataFrame, str]:
    """Rows of the next ``size`` numbers (column ``number``, from 1) and the cursor after them; a cursor of another snapshot
    is refused."""
    start = 0
    if at is not None:
        of, start = json.loads(base64.urlsafe_b64decode(at))
        if of != sealed:
            raise Stale("the cursor belongs to another snapshot")
    return rows.where((F.col("number") > start) & (F.col("number") <= start + size)), cursor(sealed, start + size)


def selected(rows: DataFrame, numbers: list[int], sealed: str, reviewed: str) -> DataFrame:
    """The rows of chosen numbers; numbers that weren't offered, repeated ones or another review are refused as a whole."""
    if sealed != reviewed:
        raise Stale("another snapshot was reviewed")
    if len(set(numbers)) != len(numbers):
        raise ValueError("a number is chosen twice")
    found = rows.where(F.col("number").isin(numbers)) if numbers else rows.limit(0)
    if found.count() != len(numbers):
        raise ValueError("a chosen number wasn't offered")
    return found


def stale_rows(frozen: DataFrame, current: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """(key) of frozen rows whose evidence is no longer as it was; only the frozen rows are looked up."""
    now = current.select(key, *(F.col(s).alias(f"_now_{s}") for s in sources), F.lit(1).alias("_there"))
    same = F.col("_there").isNotNull()
    for s in sources:
        same = same & F.col(s).eqNullSafe(F.col(f"_now_{s}"))
    return frozen.join(now, key, "left").where(~same).select(key)


def undecided_pages(rows: DataFrame, decisions: DataFrame, size: int) -> DataFrame:
    """(page) of a snapshot's pages (from 0) that no decision covers: all must be decided before it is final."""
    pages = rows.select(F.floor((F.col("number") - 1) / size).alias("page")).distinct()
    return pages.join(decisions.select("page").distinct(), "page", "left_anti")
