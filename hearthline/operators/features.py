"""Model features from cleaned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import MODEL_FEATURES, OCCUPANCY_HOURS, HeatConfig
from hearthline.functions.clock import is_weekend
from hearthline.functions.zones import mean_zone_temp


def delta_t(mean_temp: Column, oat: Column) -> Column:
    """Indoor minus outdoor temperature, not below zero; unknown when either is."""
    return F.when(mean_temp < oat, 0.0).otherwise(mean_temp - oat)


def occupancy_index(hour_start: Column) -> Column:
    """Position of the row's occupancy indicator among the feature columns, null for none.

    At most one of the indicators of a row is set, so the position says it all.
    """
    weekdays = F.array(*[F.lit(h) for h in OCCUPANCY_HOURS])
    place = F.array_position(weekdays, F.hour(hour_start))
    offset = F.when(is_weekend(hour_start), len(OCCUPANCY_HOURS)).otherwise(0)
    return F.when(place > 0, place - 1 + offset + len(MODEL_FEATURES)).cast("int")


def occupancy_dummies(df: DataFrame) -> DataFrame:
    """0/1 columns for chosen hours on weekdays and on weekends."""
    hour, weekend = F.hour("hour_start"), is_weekend(F.col("hour_start"))
    flags = {f"wd_hour_{h}": (hour == h) & ~weekend for h in OCCUPANCY_HOURS}
    flags |= {f"we_hour_{h}": (hour == h) & weekend for h in OCCUPANCY_HOURS}
    return df.withColumns({name: flag.cast("double") for name, flag in flags.items()})


def engineer_features(cleaned: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Temperature, wind and lag features; the first row of a house has no lag and goes."""
    in_time = Window.partitionBy("house_alias").orderBy("hour_start")
    rows = (
        cleaned.withColumns({
            "day": F.to_date("hour_start"),
            "temp_avg": mean_zone_temp(),
            "position": F.row_number().over(in_time),
            "previous_dist_kwh": F.lag("dist_kwh").over(in_time),
        })
        .withColumn("deltaT", delta_t(F.col("temp_avg"), F.col("oat_f")))
        .withColumns({
            "windspeed_times_deltaT": F.col("ws_mph") * F.col("deltaT"),
            "windspeed_times_65_minus_oat": F.col("ws_mph") * (F.lit(65.0) - F.col("oat_f")),
        })
        .where(F.col("position") > 1)
        .drop("position")
    )
    return occupancy_dummies(rows) if cfg.include_occupancy else rows
