"""Search queries as documents: checked, given defaults, and compiled to one plan of cells."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of conditions and their fields.
FIELDS = {
    "object_count": {"class_id", "operator", "value", "score_threshold"},
    "ocr_contains": {"text"},
    "color_fraction": {"color", "minimum"},
    "subject_position": {"horizontal", "vertical"},
    "scene": {"scene_id", "minimum"},
    "has_near_duplicate": {"metric", "max_distance"},
    "semantic": {"vector"},
}


class InvalidQuery(ValueError):
    """The query document isn't valid."""


def fingerprint(value) -> str:
    """SHA-256 of a document's canonical JSON."""
    return sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


@dataclass(frozen=True)
class Query:
    """``conditions``: (id, kind, fields); ``aliases``: ids of repeated conditions to the one that is evaluated."""

    conditions: tuple[tuple[str, str, dict], ...]
    operator: str
    limit: int | None
    aliases: dict[str, str]


def normalize(document: dict) -> Query:
    """A checked query: unknown fields, kinds or values are errors, equal conditions are evaluated once."""
    unknown = set(document) - {"conditions", "operator", "candidate_limit"}
    if unknown or not isinstance(document.get("conditions"), list) or not document["conditions"]:
        raise InvalidQuery(f"unknown fields or no conditions: {sorted(unknown)}")
    operator, limit = document.get("operator"), document.get("candidate_limit", 10)
    if operator is None and len(document["conditions"]) == 1:
        operator = "and"
    if operator not in ("and", "or"):
        raise InvalidQuery("operator must be and or or")
    if limit != "all" and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 1):
        raise InvalidQuery("candidate_limit must be a positive number or all")
    seen: dict[str, str] = {}
    kept, aliases = [], {}
    for c in document["conditions"]:
        kind, name = c.get("kind"), c.get("id")
        fields = {k: v for k, v in c.items() if k not in ("kind", "id")}
        if kind not in FIELDS or not isinstance(name, str) or not name or set(fields) != FIELDS[kind]:
            raise InvalidQuery(f"condition {name!r}: kind or fields")
        if name in aliases or any(name == k[0] for k in kept):
            raise InvalidQuery(f"condition {name!r} repeated")
        if kind == "object_count" and (fields["operator"] not in ("eq", "ge", "le") or fields["value"] < 0):
            raise InvalidQuery(f"condition {name!r}: operator or value")
        if kind == "scene" and not -1 <= fields["minimum"] <= 1 or kind == "color_fraction" and not 0 <= fields["minimum"] <= 1:
            raise InvalidQuery(f"condition {name!r}: minimum")
        identity = fingerprint([kind, fields])
        if identity in seen:
            aliases[name] = seen[identity]
        else:
            seen[identity] = name
            kept.append((name, kind, fields))
    return Query(tuple(kept), operator, None if limit == "all" else limit, aliases)


def cells_of(scope: DataFrame, item: str, cells: dict[str, Column]) -> DataFrame:
    """(item, condition_id, status, raw_score, reason) of one scan of ``scope``: a row for each item and condition."""
    rows = F.array(*(F.struct(F.lit(name).alias("condition_id"), c["status"].alias("status"), c["raw_score"].alias("raw_score"), c["reason"].alias("reason")) for name, c in cells.items()))
    return scope.select(F.col(item).alias("item"), F.inline(rows))


def compile_cells(query: Query, scope: DataFrame, item: str, evaluators: dict[str, Callable[[dict], Column]]) -> DataFrame:
    """The cells of a query over ``scope``; ``evaluators``: kind to a function from a condition's fields to its cell."""
    return cells_of(scope, item, {name: evaluators[kind](fields) for name, kind, fields in query.conditions})
