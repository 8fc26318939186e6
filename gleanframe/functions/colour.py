"""Names of colours, by hue, saturation and value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of hue in degrees, and the name below each.
HUES = ((15, "red"), (45, "orange"), (75, "yellow"), (165, "green"), (195, "cyan"), (255, "blue"), (285, "purple"), (345, "magenta"))
#: Below this value black; below this saturation gray, or white from this value on.
BLACK_BELOW, GRAY_BELOW, WHITE_FROM = 0.2, 0.15, 0.85


def palette_color(red: Column, green: Column, blue: Column) -> Column:
    """The name of an sRGB colour of channels 0 to 255; NULL if a channel is."""
    r, g, b = (c.cast("double") / 255 for c in (red, green, blue))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    reach = high - low
    hue = 60 * (
        F.when(reach == 0, 0.0)
        .when(r == high, F.pmod(F.try_divide(g - b, reach), F.lit(6.0)))
        .when(g == high, F.try_divide(b - r, reach) + 2)
        .otherwise(F.try_divide(r - g, reach) + 4)
    )
    named = F.lit("red")
    for bound, name in reversed(HUES):
        named = F.when(hue < bound, name).otherwise(named)
    grey = F.when(high >= WHITE_FROM, "white").otherwise("gray")
    known = red.isNotNull() & green.isNotNull() & blue.isNotNull()
    return F.when(known, F.when(high < BLACK_BELOW, "black").when(F.coalesce(F.try_divide(reach, high), F.lit(0.0)) < GRAY_BELOW, grey).otherwise(named))
