"""Downscaling of gridded temperatures to points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kelvin at 0 degrees Celsius; degrees per metre that maxima and minima fall with height.
KELVIN, LAPSE_TMAX, LAPSE_TMIN = 273.15, -0.0065, -0.003
#: Height difference up to which a grid value stands for a place, in metres.
CONFIDENT_M = 200.0


def celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(KELVIN)


def nan_to_null(value: Column) -> Column:
    """Grids mark missing values by NaN, which Spark's max takes for the largest number."""
    return F.when(~F.isnan(value), value)


def lapse_adjust(value: Column, difference_m: Column, rate: float) -> Column:
    """A temperature moved by a height difference, place minus grid."""
    return value + difference_m * F.lit(rate)


def bilinear(sw: Column, se: Column, nw: Column, ne: Column, fx: Column, fy: Column) -> Column:
    """Bilinear mean of four corners; the job fails if a fraction is NaN or not within [0, 1]."""
    good = fx.between(0, 1) & fy.between(0, 1) & ~F.isnan(fx) & ~F.isnan(fy)
    south, north = sw + (se - sw) * fx, nw + (ne - nw) * fx
    return F.when(good, south + (north - south) * fy).otherwise(F.raise_error(F.lit("fractions must lie in [0, 1]")).cast("double"))


def grid_index(value: Column, first: float, step: float, n: int) -> Column:
    """Index of the cell's lower corner on an axis of n nodes, which may descend; points outside clamp to the edge."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor((value - F.lit(first)) / F.lit(step)))).cast("int")


def grid_fraction(value: Column, first: float, step: float, n: int) -> Column:
    """Share of the way from the lower corner to the next node, 0 to 1."""
    at = (value - F.lit(first)) / F.lit(step) - grid_index(value, first, step, n)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))


def nearest_index(value: Column, first: float, step: float) -> Column:
    return F.floor((value - F.lit(first)) / F.lit(step) + 0.5).cast("int")


def elevation_confident(place_m: Column, grid_m: Column) -> Column:
    return F.abs(place_m - grid_m) <= CONFIDENT_M
