"""Lengths: twips, points, half and eighth points, EMU and CSS pixels, as column expressions.

Reading divides; writing back rounds half up, which floor(x + 0.5) does and round() does not for negative halves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units to the inch.
TWIPS, POINTS, EMU, PX = 1440, 72, 914400, 96


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def _points_px(p: Column) -> Column:
    return p * PX / POINTS


def _px_points(p: Column) -> Column:
    return p * POINTS / PX


#: Name -> expression of a length.
UNITS = {
    "twips_to_points": lambda x: x / (TWIPS // POINTS),
    "twips_to_px": lambda x: _points_px(x / (TWIPS // POINTS)),
    "points_to_px": _points_px,
    "px_to_points": _px_points,
    "half_points_to_points": lambda x: x / 2,
    "half_points_to_px": lambda x: _points_px(x / 2),
    "eighth_points_to_points": lambda x: x / 8,
    "eighth_points_to_px": lambda x: _points_px(x / 8),
    "emu_to_points": lambda x: x / (EMU // POINTS),
    "emu_to_px": lambda x: _points_px(x / (EMU // POINTS)),
    "points_to_twips": lambda x: half_up(x * (TWIPS // POINTS)),
    "px_to_twips": lambda x: half_up(_px_points(x) * (TWIPS // POINTS)),
    "points_to_half_points": lambda x: half_up(x * 2),
    "px_to_half_points": lambda x: half_up(_px_points(x) * 2),
    "points_to_emu": lambda x: half_up(x * (EMU // POINTS)),
    "px_to_emu": lambda x: half_up(_px_points(x) * (EMU // POINTS)),
}
