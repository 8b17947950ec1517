"""Keeping the hourly table up to date: find the holes, fetch only those, replace what they touch."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.config import HeatConfig
from hearthline.functions.clock import HOUR
from hearthline.operators import merge
from hearthline.operators.telemetry import CHANNELS_READ
from hearthline.plans.pipeline import assemble, crop
from hearthline.session import stage
from hearthline.sources import readers, writers
from hearthline.sources.store import Telemetry

DAY = "interval 1 day"
SEPARATOR = "\u0001"


class Refreshed(NamedTuple):
    ranges: int
    hours: int
    partitions: int


def open_hourly(spark: SparkSession, path: str) -> DataFrame | None:
    """The table kept by :func:`refresh_hourly` with its ``bucket`` and ``month``, or None if there is none yet."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    buckets = spark.read.parquet(f"{path}_layout").first().buckets
    typed = df.select(*schemas.HOURLY_COLUMNS, F.col("bucket").cast("int").alias("bucket"), F.col("month").cast("int").alias("month"))
    return typed.withMetadata("bucket", {readers.BUCKETS: buckets})


def read_hourly(spark: SparkSession, path: str, houses: list[str] | DataFrame | None, start: datetime, end: datetime) -> DataFrame:
    """Hours ``[start, end)`` of some houses; other months and buckets are not read."""
    cached = open_hourly(spark, path)
    if cached is None:
        return spark.createDataFrame([], schemas.HOURLY)
    return readers.of_houses(_in_months(cached, start, end), houses).select(*schemas.HOURLY_COLUMNS)


def _month(hour: Column) -> Column:
    return F.year(hour) * 100 + F.month(hour)


def _in_months(cached: DataFrame, start: datetime, end: datetime) -> DataFrame:
    months = F.col("month").between(start.year * 100 + start.month, end.year * 100 + end.month)
    return crop(cached.where(months), start, end)


def _to_utc(local: Column, cfg: HeatConfig) -> Column:
    return F.convert_timezone(F.lit(cfg.timezone), F.lit("UTC"), local)


def fetch_hours(telemetry: Telemetry, ranges: DataFrame, cfg: HeatConfig, substring: bool = False) -> DataFrame:
    """Hourly rows of staged ``ranges`` (house_alias, range_start, range_end; local hours) and of nothing else.

    Every range is built as if it were fetched alone: flow batches count from its start, and it
    sees the messages from the look-back before its start to its end. The ranges' houses, their
    days, and the span of all become predicates of the scans; a row then meets its range by house
    and day.
    """
    timed = ranges.select(
        "house_alias", "range_start", "range_end",
        F.concat_ws(SEPARATOR, "house_alias", F.col("range_start").cast("string")).alias("key"),
        _to_utc(F.col("range_start"), cfg).alias("since"), _to_utc(F.col("range_end"), cfg).alias("until"),
    )
    back = F.expr(f"interval {int(cfg.forecast_lookback_hours)} hours")
    first, last = timed.agg(F.min("since"), F.max("until")).first()
    if first is None:
        return ranges.sparkSession.createDataFrame([], schemas.HOURLY)

    def per_day(since: Column) -> DataFrame:
        days = F.explode(F.sequence(F.to_date(since), F.to_date("until"), F.expr(DAY)))
        return timed.select("house_alias", days.alias("day"), "key", "since", "until")

    def on_days(table: DataFrame, since: Column) -> DataFrame:
        """Rows of the days that any range needs: calendar days at most, known before the scan."""
        if readers.buckets_of(table) is None:
            return table
        days = [r.day for r in per_day(since).select("day").distinct().collect()]
        return table.where(F.col("day").isin(days))

    def in_ranges(rows: DataFrame, since: Column) -> DataFrame:
        columns = [c for c in rows.columns if c != "house_alias"]
        met = rows.withColumn("day", F.to_date("ts")).join(per_day(since), ["house_alias", "day"])
        return met.where((F.col("ts") >= since) & (F.col("ts") < F.col("until"))).select(F.col("key").alias("house_alias"), *columns, "since")

    own, before = F.col("since"), F.col("since") - back
    houses = ranges.select("house_alias")
    more = (houses, substring, telemetry.aliases)
    seconds = readers.scan_readings_1s(on_days(telemetry.readings_1s, own), first, last, CHANNELS_READ, *more)
    named = readers.scan_readings_with_channels(on_days(telemetry.readings, own), telemetry.channels, first, last, *more)
    parsed = readers.scan_forecast_messages(on_days(telemetry.messages, before), first, last, cfg, *more)
    hours = F.explode(F.sequence("range_start", F.col("range_end") - F.expr(HOUR), F.expr(HOUR)))
    skeleton = timed.select(F.col("key").alias("house_alias"), hours.alias("hour_start"))
    built = assemble(
        skeleton, in_ranges(seconds, own), in_ranges(named, own).drop("since"), in_ranges(parsed, before).drop("since"), own, cfg
    )
    return built.withColumn("house_alias", F.substring_index("house_alias", SEPARATOR, 1))


def refresh_hourly(
    spark: SparkSession, cache: str, telemetry: Telemetry, houses: DataFrame, start: datetime, end: datetime, cfg: HeatConfig,
    force: bool = False, substring: bool = False, buckets: int = 64,
) -> Refreshed:
    """Bring the table at ``cache`` up to date for ``houses`` and the local hours ``[start, end)``.

    Hours without a row are fetched in contiguous ranges and merged with what their partitions
    (bucket of houses, month) hold; only those partitions are replaced, all in the commit of one
    job, so a run that fails before leaves the table as it was. A run that finds no hole writes
    nothing. With ``force`` every requested hour is fetched, and of the requested houses nothing
    else is kept. ``buckets`` counts for a new table only.
    """
    cached = open_hourly(spark, cache)
    if cached is not None:
        buckets = readers.buckets_of(cached)
    houses = stage(readers.requested(houses), "houses")
    missing = merge.expected_hours(houses, start, end)
    if cached is not None and not force:
        missing = merge.missing_hours(missing, readers.of_houses(_in_months(cached, start, end), houses))
    ranges = stage(merge.fetch_ranges(missing), "ranges")
    n = ranges.count()
    if not n:
        return Refreshed(0, 0, 0)

    fetched = fetch_hours(telemetry, ranges, cfg, substring).select(*schemas.HOURLY_COLUMNS)
    place = [readers.bucket_of(F.col("house_alias"), buckets).alias("bucket"), _month(F.col("hour_start")).alias("month")]
    fetched = stage(fetched.select("*", *place), "fetched")
    touched = fetched.select("bucket", "month").distinct()
    merged = fetched
    if cached is not None:
        if force:
            touched = touched.unionByName(readers.of_houses(cached, houses).select("bucket", "month").distinct()).distinct()
        # the predicate lets the touched partitions be pruned at run time
        kept = cached.join(touched.where("bucket >= 0 AND month > 0"), ["bucket", "month"], "left_semi").select(*fetched.columns)
        if force:
            kept = kept.join(houses, "house_alias", "left_anti")
        rows = merge.upsert_hours(kept.select(*schemas.HOURLY_COLUMNS), fetched.select(*schemas.HOURLY_COLUMNS))
        merged = stage(rows.select("*", *place), "merged")  # the old partitions are read before they are replaced
    # as many as months times buckets in use
    emptied = [tuple(r) for r in touched.join(merged.select("bucket", "month").distinct(), ["bucket", "month"], "left_anti").collect()] if force else []
    if cached is None:
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{cache}_layout")
    writers.replace_partitions(merged, cache, ["bucket", "month"], ["house_alias", "hour_start"])
    writers.drop_partitions(spark, cache, [f"bucket={b}/month={m}" for b, m in emptied])
    return Refreshed(n, fetched.count(), merged.select("bucket", "month").distinct().count())
