"""Numbers of decoded pictures, from their pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_hash(grid: Column) -> Column:
    """The 64-bit difference hash of 8 rows of 9 luminances (72 numbers): a bit is set where a pixel is brighter than the next,
    row by row, the first pixel highest. NULL for any other number of pixels."""
    bit = lambda i: F.when(
        F.element_at(grid, F.floor(i / 8).cast("int") * 9 + (i % 8).cast("int") + 1) > F.element_at(grid, F.floor(i / 8).cast("int") * 9 + (i % 8).cast("int") + 2),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (63 - i).cast("int")),
    ).otherwise(F.lit(0).cast("bigint"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.when(F.size(grid) == 72, F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


def hue_and_saturation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue in degrees (0 for grey) and saturation of a colour of channels 0 to 255."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    reach = (high - low).cast("double")
    hue = 60 * F.when(reach == 0, 0.0).when(r == high, F.pmod(F.try_divide(g - b, reach), F.lit(6.0))).when(g == high, F.try_divide(b - r, reach) + 2).otherwise(F.try_divide(r - g, reach) + 4)
    return hue, F.coalesce(F.try_divide(reach, high.cast("double")), F.lit(0.0))


def convex(quad: Column) -> Column:
    """Whether four points (array of [x, y]) turn the same way at every corner."""
    turns = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: (lambda p, q, s: (q[0] - p[0]) * (s[1] - q[1]) - (q[1] - p[1]) * (s[0] - q[0]))(
            F.element_at(quad, i + 1), F.element_at(quad, (i + 1) % 4 + 1), F.element_at(quad, (i + 2) % 4 + 1)
        ),
    )
    return F.coalesce((F.size(quad) == 4) & (F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)), F.lit(False))
