"""Linear colour ramps as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-colour ramp of single listings and the three-colour ramp of cells (RGB).
LISTING_RAMP = [(255, 223, 142), (198, 88, 36)]
CELL_RAMP = [(0, 128, 0), (255, 255, 0), (255, 0, 0)]


def ramp_position(value: Column, low: Column, high: Column) -> Column:
    """0 at ``low``, 1 at ``high``, clamped; 0 where both ends coincide."""
    raw = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.when(value.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def ramp_channel(position: Column, levels: list[int]) -> Column:
    """One colour channel, linear between evenly spaced ``levels``, as 0-255."""
    spans = len(levels) - 1
    scaled = position * float(spans)
    value = F.lit(float(levels[0]))
    for step in range(spans):
        part = F.least(F.greatest(scaled - float(step), F.lit(0.0)), F.lit(1.0))
        value = value + part * float(levels[step + 1] - levels[step])
    return F.floor(value / 255.0 * 255.9999).cast("int")


def ramp_hex(position: Column, ramp: list[tuple[int, int, int]]) -> Column:
    channels = [ramp_channel(position, [colour[i] for colour in ramp]) for i in range(3)]
    return F.lower(F.format_string("#%02x%02x%02x", *channels))
