"""Answers of a reviewer, read strictly."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_BYTES = 1 << 20
_FENCED = re.compile(r"\A\s*```(?:json)?\s*\n(.*?)\n```\s*\Z", re.S)


def _pairs(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a field twice")
    return found


def _refuse(name: str):
    raise ValueError(name)


def strict(text: str | None) -> str | None:
    """Canonical JSON of an answer that is one document, bare or in one fence; None for anything else: more than 1 MiB,
    fields that come twice, NaN or infinite numbers."""
    if text is None or len(text.encode()) > MOST_BYTES:
        return None
    fenced = _FENCED.match(text)
    try:
        value = json.loads(fenced[1] if fenced else text, object_pairs_hook=_pairs, parse_constant=_refuse)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def strict_json(text: pd.Series) -> pd.Series:
    return text.map(strict)


def in_order(answer: Column, asked: Column) -> Column:
    """Whether the ids of an answer are those asked for, in their order."""
    return F.coalesce(answer == asked, F.lit(False))
