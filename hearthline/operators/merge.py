"""Assembling hourly rows, filling defaults, and keeping the hourly cache up to date."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.functions.clock import HOUR
from hearthline.operators.columns import conform_columns, with_all_zones, zone_list

HOUSE_HOUR = ["house_alias", "hour_start"]


def expected_hours(houses: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Every wall-clock hour of ``[start, end)`` (local) for each house."""
    hours = F.sequence(
        F.lit(start).cast("timestamp_ntz"),
        F.lit(end).cast("timestamp_ntz") - F.expr(HOUR),
        F.expr(HOUR),
    )
    aliases = houses.select(F.lower(F.trim("house_alias")).alias("house_alias")).distinct()
    return aliases.select("house_alias", F.explode(hours).alias("hour_start"))


def merge_hours(*sources: DataFrame) -> DataFrame:
    """Bring rows of several sources together by house and hour.

    Sources have disjoint value columns (or equal values), so a union followed by one
    aggregate does the work of a chain of full outer joins with a single shuffle.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    values = [c for c in stacked.columns if c not in HOUSE_HOUR]
    return stacked.groupBy(*HOUSE_HOUR).agg(*[F.max(c).alias(c) for c in values])


def merge_hourly_sources(skeleton: DataFrame, *sources: DataFrame) -> DataFrame:
    """Hourly rows from a skeleton and its sources; hours outside the skeleton are kept."""
    return conform_columns(merge_hours(skeleton.select(*HOUSE_HOUR), *sources))


def hourly_defaults(hourly: DataFrame) -> DataFrame:
    """Hours without telemetry count as zero load, boiler power and heat call.

    Each row is also brought to the full zone list of its house.
    """
    per_house = Window.partitionBy("house_alias")
    zones = with_all_zones(F.col("zones"), F.col("zone_list"))
    zero = F.lit(0.0)
    filled = F.transform(
        zones, lambda z: z.withField("heatcall_fraction", F.coalesce(z["heatcall_fraction"], zero))
    )
    return (
        hourly.withColumn("zone_list", zone_list(per_house))
        .withColumns({c: F.coalesce(c, zero) for c in ("dist_kwh", "hp_kwh_th", "oil_boiler_pwr")})
        .withColumn("zones", filled)
        .select(*schemas.HOURLY_COLUMNS)
    )


def missing_hours(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected hours that have no row yet."""
    return expected.join(present.select(*HOUSE_HOUR), HOUSE_HOUR, "left_anti")


def fetch_ranges(hours: DataFrame) -> DataFrame:
    """Contiguous runs of hours as half-open ranges."""
    in_order = Window.partitionBy("house_alias").orderBy("hour_start")
    starts_run = F.coalesce(
        F.lag("hour_start").over(in_order) != F.col("hour_start") - F.expr(HOUR), F.lit(True)
    )
    return (
        hours.withColumn("starts_run", starts_run.cast("int"))
        .withColumn("run", F.sum("starts_run").over(in_order))
        .groupBy("house_alias", "run")
        .agg(
            F.min("hour_start").alias("range_start"),
            (F.max("hour_start") + F.expr(HOUR)).alias("range_end"),
        )
        .drop("run")
    )


def union_cache_and_fetched(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Both sets of rows by column name, remembering which is fresher."""
    return cached.withColumn("freshness", F.lit(0)).unionByName(
        fetched.withColumn("freshness", F.lit(1)), allowMissingColumns=True
    )


def upsert_hours(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per house and hour; a fetched row replaces a cached one."""
    both = union_cache_and_fetched(cached, fetched)
    values = [c for c in both.columns if c not in (*HOUSE_HOUR, "freshness")]
    newest = F.max_by(F.struct(*values), F.col("freshness"))
    return (
        both.groupBy(*HOUSE_HOUR)
        .agg(newest.alias("row"))
        .select(*HOUSE_HOUR, *[F.col("row")[c].alias(c) for c in values])
    )


def solar_fill(hourly: DataFrame, solar: DataFrame | None) -> DataFrame:
    """Fill missing irradiance from a lookup by hour.

    Without a lookup, a house that has no irradiance at all gets zero; a house that has
    some keeps its gaps for the cleaning step.
    """
    if solar is None:
        per_house = Window.partitionBy("house_alias")
        none_known = F.max("solar_w_m2").over(per_house).isNull()
        value = F.when(none_known, F.lit(0.0)).otherwise(F.col("solar_w_m2"))
        return hourly.withColumn("solar_w_m2", value)
    lookup = solar.groupBy("hour_start").agg(F.max("solar_w_m2").alias("looked_up"))
    columns = hourly.columns
    return (
        hourly.join(lookup, "hour_start", "left")
        .withColumn("solar_w_m2", F.coalesce("solar_w_m2", "looked_up"))
        .select(*columns)
    )


def zone_union(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Zones of each house over both tables."""
    both = cached.select("house_alias", "zones").unionByName(fetched.select("house_alias", "zones"))
    return both.groupBy("house_alias").agg(zone_list().alias("zone_list"))
