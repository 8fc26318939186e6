"""Areas of boxes in a picture."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from gleanframe.operators.predicates import thirds_distance


def _union(boxes) -> float:
    edges = sorted({b[k] for b in boxes for k in (0, 2)})
    area = 0.0
    for left, right in zip(edges, edges[1:]):
        reach, covered = None, 0.0
        for top, bottom in sorted((b[1], b[3]) for b in boxes if b[0] <= left and b[2] >= right):
            if reach is None or top > reach:
                covered += bottom - top
                reach = bottom
            elif bottom > reach:
                covered += bottom - reach
                reach = bottom
        area += covered * (right - left)
    return area


@F.pandas_udf(DoubleType())
def union_area(boxes: pd.Series) -> pd.Series:
    """The area that boxes (array of [left, top, right, bottom]) cover together; 0 for none, NULL for NULL."""
    return boxes.map(lambda b: None if b is None else _union([tuple(x) for x in b]))


def bounding_area(boxes: Column) -> Column:
    """The area of the least box around all boxes; NULL for none."""
    side = lambda i, f: f(F.transform(boxes, lambda b: b[i]))
    return (side(2, F.array_max) - side(0, F.array_min)) * (side(3, F.array_max) - side(1, F.array_min))


def composition(objects: Column) -> Column:
    """Numbers of a picture's objects (array of struct(score, box), boxes as parts of its sides): union_area, within [0, 1],
    bounding_area (0 without objects), uncovered_fraction, and of the main subject its index, centre, area and distance to the thirds."""
    boxes = F.transform(objects, lambda o: o["box"])
    union = F.greatest(F.lit(0.0), F.least(F.lit(1.0), union_area(boxes)))
    subject = main_subject(F.transform(objects, lambda o: F.struct(((o["box"][2] - o["box"][0]) * (o["box"][3] - o["box"][1])).alias("area"), o["score"].alias("score"))))
    side = lambda i: F.get(F.get(boxes, subject), F.lit(i))
    x, y = (side(0) + side(2)) / 2, (side(1) + side(3)) / 2
    return F.struct(
        union.alias("union_area"), F.coalesce(bounding_area(boxes), F.lit(0.0)).alias("bounding_area"), (1 - union).alias("uncovered_fraction"),
        subject.alias("subject_index"), x.alias("center_x"), y.alias("center_y"), ((side(2) - side(0)) * (side(3) - side(1))).alias("subject_area"), thirds_distance(x, y).alias("thirds_distance"),
    )


def main_subject(objects: Column) -> Column:
    """The index of the object (struct(area, score)) that is largest, then surest, then first."""
    ranked = F.transform(objects, lambda o, i: F.struct((-o["area"]).alias("a"), (-o["score"]).alias("s"), i.alias("i")))
    return F.array_min(ranked)["i"]


@F.pandas_udf(ArrayType(IntegerType()))
def suppress_overlaps(boxes: pd.Series, scores: pd.Series, limit: pd.Series) -> pd.Series:
    """Indexes of the boxes kept, surest first, when those that overlap a kept one by more than ``limit`` are dropped. Boxes are
    of whole pixels, the last one included, so a side is one longer than the difference of its ends."""

    def keep(b, s, most):
        if b is None:
            return None
        kept: list[int] = []
        for i in sorted(range(len(s)), key=lambda i: (-s[i], i)):
            for j in kept:
                w = min(b[i][2], b[j][2]) - max(b[i][0], b[j][0]) + 1
                h = min(b[i][3], b[j][3]) - max(b[i][1], b[j][1]) + 1
                shared = max(w, 0) * max(h, 0)
                whole = sum((b[k][2] - b[k][0] + 1) * (b[k][3] - b[k][1] + 1) for k in (i, j)) - shared
                if whole > 0 and shared / whole > most:
                    break
            else:
                kept.append(i)
        return kept

    return pd.Series([keep(*x) for x in zip(boxes, scores, limit)])
