"""Heating-shaped inputs derived from an ``events`` table.

Thirty consecutive users form one house, so the number of houses grows with the data.
Every event is used: as part of an hourly aggregate, as one irregular reading, as the
start of a burst of one-second readings, and as one message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USERS_PER_HOUSE = 30
BURST_SECONDS = 40
EVENTS_PER_TASK = 20_000

# event type -> (position, channel name, unit)
EVENT_CHANNELS = (
    ("view", 0, "zone1-down-temp", "AirTempFTimes1000"),
    ("click", 1, "zone1-down-set", "AirTempFTimes1000"),
    ("purchase", 2, "zone1-down-heat-call", "Binary"),
    ("signup", 3, "zone1-up-temp", "AirTempFTimes1000"),
    ("error", 4, "oil-boiler-pwr", "PowerW"),
)


def _house_number() -> Column:
    return F.floor(F.col("user_id") / USERS_PER_HOUSE)


def _house_alias(number: Column) -> Column:
    return F.concat(F.lit("h"), number.cast("string"))


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0)


def hourly_from_events(events: DataFrame) -> DataFrame:
    """One row per house and hour with data. Odd houses have one zone, even ones two."""
    load_event = F.col("event_type").isin("view", "click", "purchase")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    grouped = (
        events.select(
            _house_number().alias("house_id"),
            hour.alias("hour_start"),
            "event_type",
            "value",
            _k().cast("double").alias("k"),
        )
        .groupBy("house_id", "hour_start")
        .agg(
            F.count("*").alias("n"),
            F.avg("k").alias("k_avg"),
            F.avg(F.when(load_event, F.col("value"))).alias("load_raw"),
            F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("hp_raw"),
            F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("err_max"),
        )
    )
    h = F.hour("hour_start")
    # snapped, so that thresholds downstream do not depend on summation order
    grouped = grouped.withColumns(
        {c: F.round(c, 9) for c in ("k_avg", "load_raw", "hp_raw", "err_max")}
    )
    setpoint = F.when(h.between(6, 21), 68.0).otherwise(66.0)
    oat = F.lit(20) + F.col("k_avg") * 0.5
    zone1 = F.struct(
        F.lit(1).alias("zone"),
        setpoint.alias("avg_set"),
        (setpoint + (F.col("k_avg") - 40) / 40).alias("avg_temp"),
        F.least(F.lit(1.0), F.col("load_raw") / 100).alias("heatcall_fraction"),
    )
    zone2 = F.struct(
        F.lit(2).alias("zone"),
        F.lit(67.0).alias("avg_set"),
        (F.lit(67.0) + (F.col("k_avg") - 45) / 30).alias("avg_temp"),
        F.least(F.lit(1.0), F.col("hp_raw") / 90).alias("heatcall_fraction"),
    )

    def trajectory(first: Column, step: float) -> Column:
        # three hours out of four carry a forecast; every fourth one is short
        length = F.when(h % 4 == 0, 20).when(h % 4 != 1, 48)
        return F.transform(
            F.sequence(F.lit(0), length - 1), lambda i: first + (i % 7).cast("double") * step
        )

    return grouped.select(
        _house_alias(F.col("house_id")).alias("house_alias"),
        "hour_start",
        oat.alias("oat_f"),
        (F.col("n") * F.lit(1.5)).alias("ws_mph"),
        F.greatest(F.lit(0), F.lit(600) - F.lit(100) * F.abs(h - 12)).cast("double").alias("solar_w_m2"),
        (F.col("load_raw") / 8).alias("dist_kwh"),
        (F.col("hp_raw") / 8 * 1.05 - 0.05).alias("hp_kwh_th"),
        (F.lit(100) + F.col("load_raw") * 0.5).alias("swt_average_f"),
        (F.lit(90) + F.col("load_raw") * 0.4 + F.col("k_avg") * 0.1).alias("rwt_average_f"),
        (F.lit(400) + F.col("load_raw") * 10).alias("dist_water_kg"),
        (F.coalesce(F.col("err_max"), F.lit(0.0)) / 4).alias("oil_boiler_pwr"),
        trajectory(oat, 0.25).alias("oat_f_forecast"),
        trajectory(F.col("n") * F.lit(1.5), 0.5).alias("ws_mph_forecast"),
        F.when(F.col("house_id") % 2 == 0, F.array(zone1, zone2)).otherwise(F.array(zone1)).alias("zones"),
    )


def readings_1s_from_events(events: DataFrame) -> DataFrame:
    """A burst of one-second readings on six channels for each event.

    The first ``k % 25`` seconds of a burst are dry, so flow runs end up both shorter and
    longer than the onset delay.
    """
    seconds = F.explode(F.sequence(F.lit(0), F.lit(BURST_SECONDS - 1)))
    # every event grows 240-fold, so the events, not the readings, are spread over tasks; the
    # number is given because the small events would otherwise be coalesced into few tasks, and
    # grows with the events, so that what a task makes and groups doesn't
    tasks = max(
        int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // EVENTS_PER_TASK)
    )
    # columns stand below the explode that repeats them: above it they are worked out for every row
    parts = events.repartition(tasks, "event_id").select(
        _house_alias(_house_number()).alias("house_alias"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("t0"),
        "value",
        _k().cast("int").alias("k"),
    )
    bursts = parts.select("house_alias", "t0", "value", "k", seconds.alias("i")).select(
        "house_alias", (F.col("t0") + F.make_dt_interval(secs=F.col("i"))).alias("ts"), "value", "k", "i"
    )

    def reading(channel: str, unit: str, value: Column) -> Column:
        return F.struct(
            F.lit(channel).alias("channel_name"), F.lit(unit).alias("unit"), value.cast("double").alias("value")
        )

    flow, water = "GpmTimes100", "WaterTempCTimes1000"
    k, v = F.col("k"), F.col("value")
    readings = F.array(
        reading("dist-flow", flow, F.when(F.col("i") < k % 25, 0).otherwise(100 + k)),
        reading("primary-flow", flow, 200 + k),
        reading("dist-swt", water, 40000 + v * 10),
        reading("dist-rwt", water, 35000 + v * 8),
        reading("hp-lwt", water, 45000 + v * 10),
        reading("hp-ewt", water, 41000 + v * 9),
    )
    return bursts.select("house_alias", "ts", F.explode(readings).alias("r")).select(
        "house_alias", "ts", "r.channel_name", "r.unit", "r.value"
    )


def _event_position() -> Column:
    position = F.lit(None).cast("int")
    for event_type, number, _, _ in EVENT_CHANNELS:
        position = F.when(F.col("event_type") == event_type, number).otherwise(position)
    return position


def readings_from_events(events: DataFrame) -> DataFrame:
    """Each event as one irregular reading of the channel its type stands for."""
    k, v = _k().cast("double"), F.col("value")
    value = (
        F.when(F.col("event_type").isin("view", "signup"), 66000 + k * 50)
        .when(F.col("event_type") == "click", F.when(k > 50, 68000.0).otherwise(66000.0))
        .when(F.col("event_type") == "purchase", F.when(v > 50, 1.0).otherwise(0.0))
        .otherwise(v)
    )
    return events.select(
        (_house_number() * 10 + _event_position()).cast("bigint").alias("channel_id"),
        "ts",
        value.alias("value"),
    )


def channels_from_events(events: DataFrame) -> DataFrame:
    """The channel list that goes with :func:`readings_from_events`."""
    number = _house_number()
    name, unit = F.lit(None).cast("string"), F.lit(None).cast("string")
    for event_type, _, channel, channel_unit in EVENT_CHANNELS:
        name = F.when(F.col("event_type") == event_type, channel).otherwise(name)
        unit = F.when(F.col("event_type") == event_type, channel_unit).otherwise(unit)
    return events.select(
        (number * 10 + _event_position()).cast("bigint").alias("id"),
        name.alias("name"),
        unit.alias("unit"),
        _house_alias(number).alias("house_alias"),
    ).distinct()


def messages_from_events(events: DataFrame) -> DataFrame:
    """Each event as a message; views carry a weather forecast, some shorter, some empty."""
    k = _k().cast("int")
    length = F.when(k % 10 == 0, 0).when(k % 3 == 0, 20).otherwise(48)
    steps = F.slice(F.sequence(F.lit(0), F.lit(47)), F.lit(1), length)
    payload = F.to_json(
        F.struct(
            F.transform(steps, lambda i: i.cast("string")).alias("Time"),
            F.transform(steps, lambda i: F.lit(20) + k * 0.5 + i * 0.25).alias("OatF"),
            F.transform(steps, lambda i: (k % 20) + i * 0.5).alias("WindSpeedMph"),
        )
    )
    return events.select(
        "ts",
        F.when(F.col("event_type") == "view", "weather.forecast")
        .otherwise(F.col("event_type"))
        .alias("message_type_name"),
        _house_alias(_house_number()).alias("from_alias"),
        payload.alias("payload"),
    )


def solar_from_events(events: DataFrame) -> DataFrame:
    """An irradiance lookup for the hours that occur in the events, one row per hour."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return (
        events.select(hour.alias("hour_start"))
        .distinct()
        .withColumn(
            "solar_w_m2",
            F.greatest(F.lit(0), F.lit(500) - F.lit(90) * F.abs(F.hour("hour_start") - 13)).cast("double"),
        )
    )
