"""Return-water temperature by load band, and water flow at constant heat call."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import CHC_REFERENCE_HEATCALL, RWT_MIN_F, HeatConfig
from hearthline.functions.numbers import settle
from hearthline.functions.zones import any_heatcall_missing, max_zone_heatcall


def rswt_rows(features: DataFrame) -> DataFrame:
    """Hours with both water temperatures, the load and every heat call known."""
    complete = (
        F.col("swt_average_f").isNotNull()
        & F.col("rwt_average_f").isNotNull()
        & F.col("dist_kwh").isNotNull()
        & ~F.coalesce(any_heatcall_missing(), F.lit(False))
    )
    return features.where(complete).select(
        "house_alias", "hour_start", "day", "swt_average_f", "rwt_average_f", "dist_kwh", "dist_water_kg",
        max_zone_heatcall().alias("max_zone_heatcall"),
    )


def load_band(load: Column, cfg: HeatConfig) -> Column:
    """Name of the band; bounds are closed below and open above, the last has no end."""
    name = F.lit(None).cast("string")
    for low, high, label in cfg.load_bands:
        inside = load >= low
        if math.isfinite(high):
            inside = inside & (load < high)
        name = F.when(inside, label).otherwise(name)
    return name


def mid_loads(cfg: HeatConfig) -> dict[str, float]:
    """Middle of each band; the open one reaches half a band width past its start."""
    mids = {}
    for i, (low, high, label) in enumerate(cfg.load_bands):
        if math.isfinite(high):
            mids[label] = (low + high) / 2
        else:
            mids[label] = low + (low - cfg.load_bands[i - 1][0]) / 2
    return mids


def fit_rswt_bands(rows: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Line of return over supply temperature per house and load band.

    A band with too few hours keeps its count but gets no line. If all its supply
    temperatures are equal the minimum-norm line is returned.
    """
    swt, rwt = F.col("swt_average_f"), F.col("rwt_average_f")
    grouped = rows.withColumn("band", load_band(F.col("dist_kwh"), cfg)).groupBy("house_alias", "band").agg(
        F.count("*").alias("n_hours"),
        F.regr_slope(rwt, swt).alias("slope"),
        F.regr_intercept(rwt, swt).alias("intercept"),
        F.min(swt).alias("low"),
        F.max(swt).alias("high"),
        F.avg(rwt).alias("mean_rwt"),
    )
    enough = F.col("n_hours") >= cfg.band_min_rows
    level = F.col("low") == F.col("high")
    norm = F.col("mean_rwt") / (F.lit(1.0) + F.col("low") * F.col("low"))
    intercept = F.when(level, norm).otherwise(F.col("intercept"))
    slope = F.when(level, norm * F.col("low")).otherwise(F.col("slope"))
    return grouped.select(
        "house_alias",
        "band",
        "n_hours",
        F.when(enough, settle(intercept, 6)).alias("rwt_intercept"),
        F.when(enough, settle(slope, 6)).alias("rwt_slope"),
    )


def topk_heatcall(rows: DataFrame, k: int) -> DataFrame:
    """The hours with the largest heat call, earlier hours first on ties."""
    order = Window.partitionBy("house_alias").orderBy(F.col("max_zone_heatcall").desc(), "hour_start")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def chc_water(rows: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Mean water mass per hour while heat is called for nearly all the time.

    Hours above the threshold are used when there are enough of them, otherwise the ``k``
    hours with the largest heat call. Restricting that choice to hours above the floor
    changes nothing once ``k`` such hours exist, so the pool only shows up as a label.
    """
    per_house = Window.partitionBy("house_alias")
    order = per_house.orderBy(F.col("max_zone_heatcall").desc(), "hour_start")
    heatcall = F.col("max_zone_heatcall")
    k = F.least(F.lit(cfg.band_min_rows), F.col("n_rows"))
    enough = F.col("n_above") >= cfg.band_min_rows
    return (
        rows.select(
            "house_alias",
            "dist_water_kg",
            "max_zone_heatcall",
            F.row_number().over(order).alias("place"),
            F.count("*").over(per_house).alias("n_rows"),
            F.count(F.when(heatcall > cfg.chc_threshold, 1)).over(per_house).alias("n_above"),
            F.count(F.when(heatcall >= cfg.chc_floor, 1)).over(per_house).alias("n_floor"),
        )
        .where(F.when(enough, heatcall > cfg.chc_threshold).otherwise(F.col("place") <= k))
        .groupBy("house_alias")
        .agg(
            settle(F.avg("dist_water_kg"), 2).alias("water_kg_hour_chc"),
            F.count("dist_water_kg").alias("n_hours"),
            F.min("max_zone_heatcall").alias("min_heatcall"),
            F.max("max_zone_heatcall").alias("max_heatcall"),
            F.max(
                F.when(enough, "above_threshold").when(F.col("n_floor") >= k, "above_floor").otherwise("all_hours")
            ).alias("pool"),
        )
    )


def rswt_params(bands: DataFrame, water: DataFrame, cfg: HeatConfig) -> DataFrame:
    """One row per house: constant minimum, water flow, and a line per band.

    A house without any fitted band or without water readings has no parameters.
    """
    labels = [label for _, _, label in cfg.load_bands]
    pick = lambda label, c: F.max(F.when(F.col("band") == label, F.col(c)))
    lines = bands.groupBy("house_alias").agg(
        *[pick(label, c).alias(f"{label}_{c}") for label in labels for c in ("rwt_intercept", "rwt_slope")],
        F.count("rwt_slope").alias("fitted"),
    )
    flows = water.where(F.col("water_kg_hour_chc").isNotNull()).select("house_alias", "water_kg_hour_chc")
    return (
        lines.where(F.col("fitted") > 0)
        .join(flows, "house_alias")
        .select(
            "house_alias",
            F.lit(RWT_MIN_F).alias("rwt_min"),
            "water_kg_hour_chc",
            *[f"{label}_{c}" for label in labels for c in ("rwt_intercept", "rwt_slope")],
        )
    )


def rswt_curve(rows: DataFrame, bands: DataFrame, cfg: HeatConfig, points: int = 100) -> DataFrame:
    """Each fitted line at evenly spaced supply temperatures over the house's range."""
    span = rows.groupBy("house_alias").agg(
        F.min("swt_average_f").alias("low"), F.max("swt_average_f").alias("high")
    )
    mid = F.create_map(*[F.lit(x) for pair in mid_loads(cfg).items() for x in pair])
    swt = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1)
    return (
        bands.where(F.col("rwt_slope").isNotNull())
        .join(span, "house_alias")
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .select(
            "house_alias", "band", "n_hours", mid[F.col("band")].alias("mid_load_kwh"), "point",
            swt.alias("swt_f"),
            (F.col("rwt_intercept") + F.col("rwt_slope") * swt).alias("rwt_f"),
        )
    )


def chc_water_line(water: DataFrame) -> DataFrame:
    """Water flow in proportion to the heat call, from none to the reference share."""
    share = F.explode(F.array(F.lit(0.0), F.lit(CHC_REFERENCE_HEATCALL)))
    return water.where(F.col("water_kg_hour_chc").isNotNull()).select(
        "house_alias", "water_kg_hour_chc", share.alias("heatcall_fraction")
    ).select(
        "house_alias",
        "heatcall_fraction",
        (F.col("water_kg_hour_chc") * (F.col("heatcall_fraction") / CHC_REFERENCE_HEATCALL)).alias("water_kg_hour"),
    )
