"""Expressions over the ``zones`` array of an hourly row.

The lambdas are SQL text: one expression each, instead of a call per operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.config import HeatConfig


def mean_zone_temp() -> Column:
    """Mean of the known zone temperatures; null when there is none."""
    known = "filter(transform(zones, z -> z.avg_temp), t -> t IS NOT NULL)"
    return F.expr(f"aggregate({known}, 0D, (total, t) -> total + t) / nullif(size({known}), 0)")


def max_zone_heatcall() -> Column:
    return F.expr("array_max(transform(zones, z -> z.heatcall_fraction))")


def any_heatcall_missing() -> Column:
    return F.expr("exists(zones, z -> z.heatcall_fraction IS NULL)")


def below_setpoint(cfg: HeatConfig) -> Column:
    return F.expr(f"exists(zones, z -> z.avg_set - z.avg_temp >= {float(cfg.below_setpoint_f)}D)")


def setpoint_differs(earlier: str) -> Column:
    """Some zone has another setpoint than the same zone in the array ``earlier``."""
    return F.expr(
        f"exists(zones, z -> exists({earlier}, e -> e.zone = z.zone AND e.avg_set <> z.avg_set))"
    )


def _thermostat_gap(cfg: HeatConfig) -> str:
    gap = f"{float(cfg.thermostat_gap_f)}D"
    for alias, number, value in cfg.thermostat_gap_overrides:
        name = alias.replace("'", "''")
        gap = f"IF(house_alias = '{name}' AND z.zone = {int(number)}, {float(value)}D, {gap})"
    return gap


def broken_thermostat(cfg: HeatConfig) -> Column:
    """Cold without a heat call, or warm with one."""
    gap = _thermostat_gap(cfg)
    cold = f"z.heatcall_fraction = 0 AND z.avg_set - z.avg_temp >= {gap}"
    warm = f"z.heatcall_fraction > 0.01D AND z.avg_temp - z.avg_set >= {gap}"
    return F.expr(f"exists(zones, z -> ({cold}) OR ({warm}))")


def external_heat(cfg: HeatConfig) -> Column:
    """The warmest zone is well above its setpoint though nobody called for heat."""
    warmest = "array_max(transform(zones, y -> y.avg_temp))"
    return F.expr(
        f"exists(zones, z -> z.heatcall_fraction = 0 AND z.avg_temp - z.avg_set >= {float(cfg.external_heat_f)}D "
        f"AND z.avg_temp >= {warmest})"
    )
