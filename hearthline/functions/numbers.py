"""Rounding, units and thermal power."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.config import AIR_TEMP_UNIT, FLOW_UNIT, WATER_TEMP_UNIT


def settle(value: Column, digits: int) -> Column:
    """Round half up after snapping to nine decimals.

    A distributed mean depends on summation order in its last bits; snapping first keeps
    values that lie on a rounding boundary from flipping between runs.
    """
    return F.round(F.round(value, 9), digits)


def null_if_nan(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def decode_units(value: Column, unit: Column) -> Column:
    """Fixed-point reading to a physical value; units without a scale pass through."""
    return (
        F.when(unit == FLOW_UNIT, value / 100)
        .when(unit.isin(WATER_TEMP_UNIT, AIR_TEMP_UNIT), value / 1000)
        .otherwise(value)
    )


def thermal_power_kw(gpm: Column, hot_c: Column, cold_c: Column) -> Column:
    """Heat carried by a water flow; null when any part is unknown."""
    return F.lit(500) * gpm * (hot_c - cold_c) * 9 / 5 / 3410


def celsius_to_f(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32
