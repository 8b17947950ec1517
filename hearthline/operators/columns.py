"""Column lists, zones, and the conversion between wide files and hourly rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline import schemas
from hearthline.functions.numbers import null_if_nan

_HOURLY_TYPES = schemas.HOURLY
_WIDE_ZONE = re.compile(r"^zone([0-9]+)_avg_set$")
_ZONE_FIELDS = ("avg_set", "avg_temp", "heatcall_fraction")


def conform_columns(df: DataFrame) -> DataFrame:
    """Exactly the hourly columns: extras dropped, absent ones null, NaN made null."""
    columns = []
    for wanted in _HOURLY_TYPES:
        if wanted.name not in df.columns:
            columns.append(F.lit(None).cast(wanted.dataType).alias(wanted.name))
            continue
        value = F.col(wanted.name)
        if isinstance(df.schema[wanted.name].dataType, T.StringType) and isinstance(
            wanted.dataType, T.ArrayType
        ):
            value = F.from_json(value, wanted.dataType)
        value = value.cast(wanted.dataType)
        if isinstance(wanted.dataType, T.DoubleType):
            value = null_if_nan(value)
        columns.append(value.alias(wanted.name))
    return df.select(*columns)


def zones_in_columns(names: list[str]) -> list[int]:
    """Zone numbers that occur in the column names of a wide file."""
    return sorted(int(m.group(1)) for m in map(_WIDE_ZONE.match, names) if m)


def zone_struct_from_wide(wide: DataFrame) -> DataFrame:
    """Fold ``zone<k>_*`` columns into the ``zones`` array."""

    def part(zone: int, field: str) -> Column:
        name = f"zone{zone}_{field}"
        value = null_if_nan(F.col(name).cast("double")) if name in wide.columns else F.lit(None)
        return value.cast("double").alias(field)

    structs = [
        F.struct(F.lit(z).cast("int").alias("zone"), *[part(z, f) for f in _ZONE_FIELDS])
        for z in zones_in_columns(wide.columns)
    ]
    # a header may name zones of other houses: without any value there is no such zone here
    zones = F.array(*structs) if structs else F.array()
    if structs:
        zones = F.filter(zones, lambda z: F.coalesce(*[z[f] for f in _ZONE_FIELDS]).isNotNull())
    return wide.withColumn("zones", zones.cast(_HOURLY_TYPES["zones"].dataType))


def discover_zones(hourly: DataFrame) -> DataFrame:
    """Every zone number seen in a house, sorted. One small row per house."""
    return hourly.groupBy("house_alias").agg(zone_list().alias("zone_list"))


def zone_list(window: WindowSpec | None = None) -> Column:
    """Distinct zone numbers, as an aggregate or over a window.

    The state holds distinct zone sets, not rows.
    """
    sets = F.collect_set(F.transform("zones", lambda z: z["zone"]))
    if window is not None:
        sets = sets.over(window)
    return F.sort_array(F.array_distinct(F.flatten(sets)))


def wide_columns(zones: list[int]) -> list[str]:
    """Column order of a wide hourly file."""
    house_level = [c for c in schemas.HOURLY_COLUMNS if c not in ("house_alias", "zones")]
    heat = [f"zone{z}_heatcall_fraction" for z in zones]
    pairs = [f"zone{z}_{f}" for z in zones for f in ("avg_set", "avg_temp")]
    return house_level + heat + pairs


def hourly_wide(hourly: DataFrame, zones: list[int]) -> DataFrame:
    """One column per zone quantity; zones a house does not have are null."""

    def value(zone: int, field: str) -> Column:
        match = F.filter("zones", lambda z: z["zone"] == zone)
        return F.get(match, F.lit(0))[field]

    out = hourly.select("*", *[
        value(z, f).alias(f"zone{z}_{f}") for z in zones for f in _ZONE_FIELDS
    ])
    return out.select("house_alias", *wide_columns(zones))


def with_all_zones(zones: Column, zone_numbers: Column) -> Column:
    """The zones array brought to a house's full zone list; unknown parts are null."""

    def entry(number: Column) -> Column:
        found = F.get(F.filter(zones, lambda z: z["zone"] == number), F.lit(0))
        return F.struct(
            number.alias("zone"), *[found[f].alias(f) for f in _ZONE_FIELDS]
        )

    return F.transform(zone_numbers, entry)
