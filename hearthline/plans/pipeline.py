"""End-to-end plans: DataFrames in, DataFrames out, all houses at once."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import NamedTuple
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.config import HeatConfig
from hearthline.operators import backtest as B
from hearthline.operators import clean, columns, features as feat, forecast, merge, regression, rswt, sensors, sweep
from hearthline.operators import telemetry
from hearthline.session import stage
from hearthline.sources import readers


def utc(local: datetime, timezone: str) -> datetime:
    """Naive local time to naive UTC."""
    return local.replace(tzinfo=ZoneInfo(timezone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def build_hourly(
    readings_1s: DataFrame,
    readings: DataFrame,
    channels: DataFrame,
    messages: DataFrame,
    houses: DataFrame,
    start: datetime,
    end: datetime,
    cfg: HeatConfig,
    substring: bool = False,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Raw telemetry, sensors and forecasts to one hourly row per house.

    ``start`` and ``end`` are naive local times; every hour between them gets a row. Each
    input is scanned once, and everything meets in one shuffle of hourly rows. Only rows of
    ``houses`` are taken; tables of a store are read for their buckets and days alone. With
    ``substring`` a house also owns stored aliases that contain its name, found in ``aliases``
    if given.
    """
    houses = readers.requested(houses)
    since, until = utc(start, cfg.timezone), utc(end, cfg.timezone)
    seconds = readers.scan_readings_1s(readings_1s, since, until, telemetry.CHANNELS_READ, houses, substring, aliases)
    named = readers.scan_readings_with_channels(readings, channels, since, until, houses, substring, aliases)
    parsed = readers.scan_forecast_messages(messages, since, until, cfg, houses, substring, aliases)
    return assemble(merge.expected_hours(houses, start, end), seconds, named, parsed, since, cfg)


def assemble(
    skeleton: DataFrame, seconds: DataFrame, named: DataFrame, parsed: DataFrame, since: datetime | Column, cfg: HeatConfig
) -> DataFrame:
    """Hourly rows of scanned telemetry. ``since`` is where flow batches count from, a column if it differs by row."""
    wanted = F.lit(True).alias("wanted")
    slots = merge.merge_hours(
        skeleton.select("*", wanted),
        telemetry.hourly_from_seconds(seconds, since, cfg).select("*", wanted),
        sensors.sensor_hourly(named, cfg).select("*", wanted),
        forecast.latest_per_slot(forecast.dedupe_forecasts(parsed, cfg)),
    )
    # slots that only hold a message carry it to later hours but are not rows themselves
    hourly = forecast.carry_forward(slots, cfg).where("wanted")
    return merge.hourly_defaults(columns.conform_columns(hourly))


def update_cache(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache with fetched hours added or replaced."""
    return merge.upsert_hours(cached, fetched)


def crop(hourly: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return hourly.where(readers.half_open(F.col("hour_start"), start, end))


def prepare(hourly: DataFrame, solar: DataFrame | None, cfg: HeatConfig) -> DataFrame:
    """Clean hourly rows and derive the model features."""
    audit = clean.clean_audit(merge.solar_fill(hourly, solar), cfg)
    return feat.engineer_features(clean.cleaned_rows(audit), cfg)


def energy_params(features: DataFrame, cfg: HeatConfig, n: int | None = None) -> DataFrame:
    return regression.fit_energy_params(features, n, cfg)


class RswtResult(NamedTuple):
    rows: DataFrame
    bands: DataFrame
    water: DataFrame
    params: DataFrame


def rswt_params(features: DataFrame, cfg: HeatConfig, n: int | None = None) -> RswtResult:
    rows = rswt.rswt_rows(features)
    if n is not None:
        # the window counts days of the features, also days without complete rows
        days = regression.last_n_days(features.select("house_alias", "day").distinct(), n)
        rows = rows.join(days, ["house_alias", "day"], "left_semi")
    bands, water = rswt.fit_rswt_bands(rows, cfg), rswt.chc_water(rows, cfg)
    return RswtResult(rows, bands, water, rswt.rswt_params(bands, water, cfg))


class Backtest(NamedTuple):
    fits: DataFrame
    points: DataFrame
    metrics: DataFrame
    by_lead: DataFrame
    residuals: DataFrame


def fits_of(features: DataFrame, lookbacks: Column, cfg: HeatConfig) -> DataFrame:
    """Main and baseline fits of each look-back on its refit days.

    Daily moments are summed up once; a window of any length is a difference of two sums.
    """
    moments = regression.ols_moments(features, cfg)
    schedule = B.refit_schedule(moments.select("house_alias", "day"), lookbacks, cfg)
    # a row per house and day, read from both ends of a window; then a row per fit
    prefix = stage(B.prefix_moments(moments, cfg), "prefix")
    windows = stage(B.windows_of(schedule, prefix, cfg), "windows")
    return regression.solve_windows(windows, features, ["house_alias", "n", "fit_day"], cfg)


def backtest_fits(features: DataFrame, n: int, cfg: HeatConfig) -> DataFrame:
    """Fits of one look-back."""
    return fits_of(features, F.lit(n), cfg)


def score(features: DataFrame, fits: DataFrame, cfg: HeatConfig) -> Backtest:
    """Forecast from every hour with the fits in force and measure the errors."""
    forecasts = B.forecasts(B.origin_lead_join(features, cfg), fits, cfg)
    return Backtest(
        fits, B.forecast_points(forecasts), B.oos_metrics(forecasts), B.rmse_by_lead(forecasts, cfg), B.hourly_residual_ci(forecasts)
    )


def backtest(features: DataFrame, n: int, cfg: HeatConfig, staged: bool = True) -> Backtest:
    """Refit through history on ``n`` days and score forecasts from every hour."""
    if staged:
        features = stage(features, "features")
    fits = backtest_fits(features, n, cfg)
    return score(features, stage(fits, "fits") if staged else fits, cfg)


def sweep_fits(features: DataFrame, min_n: int, max_n: int, cfg: HeatConfig) -> DataFrame:
    """Fits of every look-back in ``min_n..max_n``, in one job."""
    return fits_of(features, F.explode(F.sequence(F.lit(min_n), F.lit(max_n))), cfg)


def sweep_n(features: DataFrame, min_n: int, max_n: int, cfg: HeatConfig, staged: bool = True) -> DataFrame:
    """Forecast error and coefficient steadiness per house and look-back.

    Look-backs longer than a house's history give no row for that house.
    """
    if staged:
        features = stage(features, "features")
    fits = sweep_fits(features, min_n, max_n, cfg)
    if staged:
        fits = stage(fits, "fits")
    forecasts = B.forecasts(B.origin_lead_join(features, cfg), fits, cfg)
    errors = B.oos_metrics(forecasts).select("house_alias", "n", "n_points", "rmse", "rmse_baseline")
    return sweep.coef_stability(fits, cfg).join(errors, ["house_alias", "n"], "left")


def house_status(
    houses: DataFrame, hourly: DataFrame, features: DataFrame, cfg: HeatConfig, n: int | None
) -> DataFrame:
    """What could be computed for each requested house, and what stopped the rest.

    One house without usable data never stops the others; it only shows up here. Without ``n``
    there is no backtest, and its status is null.
    """
    loaded = hourly.groupBy("house_alias").agg(F.count("*").alias("n_hours"))
    usable = features.groupBy("house_alias").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("day").alias("n_days"),
        F.sum("dist_kwh").alias("total_load"),
    )
    water = rswt_params(features, cfg)
    rows = water.rows.groupBy("house_alias").agg(F.count("*").alias("n_rswt_rows"))
    bands = water.bands.groupBy("house_alias").agg(F.count("rwt_slope").alias("n_bands"))
    flows = water.water.select("house_alias", F.col("n_hours").alias("n_water"))
    wanted = houses.select(readers.house_key(F.col("house_alias")).alias("house_alias"), F.lit(True).alias("wanted"))
    # counts are one row per house and source: they are stacked and meet in one grouping, without joins
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (wanted, loaded, usable, rows, bands, flows))
    found = [F.max(c).alias(c) for c in stacked.columns if c != "house_alias"]
    out = stacked.groupBy("house_alias").agg(*found).where("wanted")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    unusable = F.when(count("n_hours") == 0, "no_hourly_data").when(count("n_rows") == 0, "no_usable_rows")
    needed = max(cfg.min_fit_days, 1) if cfg.grow_window else n or 1
    backtest = F.coalesce(unusable, F.when(count("n_days") < needed, "no_trailing_fit"), F.lit("ok"))
    return out.select(
        "house_alias",
        count("n_hours").cast("bigint").alias("n_hours"),
        count("n_rows").cast("bigint").alias("n_rows"),
        F.coalesce(unusable, F.when(count("total_load") == 0, "no_load"), F.lit("ok")).alias("energy_status"),
        F.coalesce(
            unusable,
            F.when(count("n_rswt_rows") == 0, "no_rswt_rows")
            .when(count("n_bands") == 0, "no_band_large_enough")
            .when(count("n_water") == 0, "no_chc_water"),
            F.lit("ok"),
        ).alias("rswt_status"),
        (F.lit(None).cast("string") if n is None else backtest).alias("backtest_status"),
    )
