"""Typed conditions over evidence. Each gives a cell, not a truth value: what isn't known is never false.

A cell has status (matched, not_matched, eligible, unknown_missing_index, unknown_stale, unknown_invalid), raw_score and
reason. Evidence that isn't ready decides the status before the condition is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.colour import palette_color
from gleanframe.functions.text import contains


#: The status and reason of a cell for each kind of evidence that can't be evaluated.
GAPS = {
    "incomplete": ("unknown_invalid", "incomplete_result"),
    "missing": ("unknown_missing_index", "missing_index"),
    "stale": ("unknown_stale", "saved_input_changed"),
    "upstream_stale": ("unknown_stale", "stale_dependency"),
    "upstream_invalid": ("unknown_invalid", "invalid_dependency"),
    "upstream_missing": ("unknown_missing_index", "missing_dependency"),
    "invalid": ("unknown_invalid", "invalid_saved_result"),
}
#: Unknown statuses, worst first.
UNKNOWN = ("unknown_invalid", "unknown_stale", "unknown_missing_index")


def coverage_unknown(coverage: Column, complete: Column, upstream: Column | None = None) -> Column:
    """struct(status, reason) of evidence that can't be evaluated, NULL where it can. ``upstream``: the coverage of what the
    evidence depends on."""
    upstream = F.lit(None).cast("string") if upstream is None else upstream
    waiting = coverage == "dependency_missing"
    cases = (
        ("incomplete", coverage == "ready"),
        ("missing", coverage.isNull() | (coverage == "missing")),
        ("stale", coverage == "stale"),
        ("upstream_stale", waiting & (upstream == "stale")),
        ("upstream_invalid", waiting & upstream.isin("invalid_input", "invalid_vector")),
        ("upstream_missing", waiting),
    )
    usable = (coverage == "ready") & F.coalesce(complete, F.lit(False))
    found = F.when(usable, F.lit(None))
    for gap, test in cases:
        found = found.when(test, _gap(gap))
    return found.otherwise(_gap("invalid"))


def _gap(name: str) -> Column:
    status, reason = GAPS[name]
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def cell(matched: Column, score: Column | None = None, unknown: Column | None = None) -> Column:
    """The cell of an evaluated condition: exact conditions score 1 where matched, graded ones their score."""
    score = F.when(matched, 1.0) if score is None else score
    known = F.struct(
        F.when(matched, "matched").otherwise("not_matched").alias("status"), score.cast("double").alias("raw_score"), F.lit(None).cast("string").alias("reason")
    )
    if unknown is None:
        return known
    gap = F.struct(unknown["status"].alias("status"), F.lit(None).cast("double").alias("raw_score"), unknown["reason"].alias("reason"))
    return F.when(unknown.isNull(), known).otherwise(gap)


def whole_cell(matched: Column, score_type: str, direction: str, sources: Column, evidence: Column, score: Column | None = None, unknown: Column | None = None) -> Column:
    """``cell`` with the kind of its score (exact, fraction, cosine), the direction that is better, the results that it was read
    from, and what was seen there (NULL where unknown)."""
    known = cell(matched, score, unknown)
    seen = evidence if unknown is None else F.when(unknown.isNull(), evidence)
    return F.struct(
        known["status"].alias("status"), known["raw_score"].alias("raw_score"), F.lit(score_type).alias("score_type"), F.lit(direction).alias("direction"),
        sources.alias("sources"), seen.alias("evidence"), known["reason"].alias("reason"),
    )


def object_count(objects: Column, class_id: str, operator: str, value: int, threshold: float) -> Column:
    """Whether the objects (array of struct(class_id, score)) of a class at or above a score number ``value`` (eq, ge, le)."""
    n = F.size(F.filter(objects, lambda o: (o["class_id"] == class_id) & (o["score"] >= threshold)))
    return {"eq": n == value, "ge": n >= value, "le": n <= value}[operator]


def text_contains(normalized: Column, literal: str) -> Column:
    return contains(normalized, literal)


def color_fraction(palette: Column, color: str) -> Column:
    """Share of a palette (array of struct(r, g, b, fraction)) that has a colour's name, within [0, 1]."""
    share = F.aggregate(
        F.filter(palette, lambda p: palette_color(p["r"], p["g"], p["b"]) == color), F.lit(0.0), lambda s, p: s + p["fraction"].cast("double")
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def third(value: Column, names: tuple[str, str, str]) -> Column:
    """Which third of [0, 1] a position lies in."""
    return F.when(value < 1 / 3, names[0]).when(value < 2 / 3, names[1]).otherwise(names[2])


def horizontal_third(x: Column) -> Column:
    return third(x, ("left", "center", "right"))


def vertical_third(y: Column) -> Column:
    return third(y, ("top", "middle", "bottom"))


def thirds_distance(x: Column, y: Column) -> Column:
    """Distance to the nearest of the four points where the lines of thirds cross."""
    return F.least(*(F.hypot(x - i / 3, y - j / 3) for i in (1, 2) for j in (1, 2)))


def near_duplicate_cells(scope: DataFrame, key: str, unknown: str, links: DataFrame) -> DataFrame:
    """(key, status, peers, least_distance, best_peer) of each item of ``scope``.

    ``unknown``: a column with the status of items that can't be compared, NULL for the others; ``links``: ``peer_summary``'s
    result among comparable items. Without a peer an item isn't ``not_matched`` while any item of the scope is unknown: the
    worst unknown status (invalid, stale, missing) holds for it.
    """
    worst = scope.agg(F.min(F.array_position(F.array(*map(F.lit, UNKNOWN)), F.col(unknown))).alias("worst")).first()["worst"]
    no_peer = UNKNOWN[worst - 1] if worst else "not_matched"
    found = scope.join(links.withColumnRenamed("item", key), key, "left")
    status = F.when(F.col(unknown).isNotNull(), F.col(unknown)).when(F.col("peers").isNotNull(), "matched").otherwise(no_peer)
    return found.select(key, status.alias("status"), F.when(F.col(unknown).isNull(), F.coalesce("peers", F.lit(0))).alias("peers"), "least_distance", "best_peer")


def faulty_cells(cells: DataFrame) -> DataFrame:
    """Cells that no condition may give: unknown statuses, scores or reasons where there can't be one, or none where one must
    be, scores out of [-1, 1]."""
    status, score, reason = F.col("status"), F.col("raw_score"), F.col("reason")
    unknown = status.isin(*UNKNOWN)
    good = (
        (unknown & score.isNull() & reason.isNotNull())
        | (status.isin("matched", "eligible") & score.isNotNull() & reason.isNull())
        | ((status == "not_matched") & reason.isNull())
    )
    return cells.where(~F.coalesce(good & (score.isNull() | score.between(-1, 1)), F.lit(False)))
