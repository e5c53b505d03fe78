"""Colour scales as SQL expressions: piecewise linear between stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stops of the scales, as place, red, green, blue.
SCALES = {
    "time": [(0.00, 97, 175, 239), (0.50, 191, 188, 168), (1.00, 242, 142, 43)],
    "in_degree": [(0.00, 68, 1, 84), (0.25, 59, 82, 139), (0.50, 33, 144, 141), (0.75, 94, 201, 98), (1.00, 253, 231, 37)],
    "boundary": [(0.00, 58, 63, 74), (0.50, 180, 130, 80), (1.00, 230, 108, 117)],
    "agreement": [(0.00, 180, 68, 74), (0.50, 200, 180, 120), (0.90, 120, 180, 100), (1.00, 60, 140, 80)],
}


def colour(value: Column, scale: str = "time") -> Column:
    """``#rrggbb`` of a number of [0, 1]; clamped, null stays null."""
    stops = SCALES[scale]
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))

    def channel(c: int) -> Column:
        out = F.lit(float(stops[-1][c]))
        for a, b in zip(stops[-2::-1], stops[:0:-1], strict=True):
            out = F.when(v <= b[0], a[c] + (v - a[0]) / (b[0] - a[0]) * (b[c] - a[c])).otherwise(out)
        return F.floor(out + 0.5).cast("int")

    return F.when(value.isNotNull(), F.lower(F.format_string("#%02x%02x%02x", channel(1), channel(2), channel(3))))


def log_scale(count: Column, most: Column) -> Column:
    """Share of the logarithmic range up to ``most``; 0 where nothing has any."""
    return F.when(most > 0, F.log1p(count) / F.log1p(most)).otherwise(0.0)
