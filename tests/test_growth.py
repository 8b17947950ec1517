"""Steps whose time or shuffled bytes grew faster than their input (FINDINGS_r03)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.functions.clock import local_hour, local_time
from hearthline.operators import backtest as B
from hearthline.operators import telemetry
from hearthline.session import configure
from hearthline.sources import adapters
from test_plans import exchanges, plan

T0 = datetime(2024, 1, 10, 12)


def _frame(spark):
    return spark.createDataFrame([("h1", T0, "dist-flow", "GpmTimes100", 1.0)], schemas.READINGS_1S)


def test_seconds_travel_four_to_a_row(spark):
    found = exchanges(telemetry.pivot_channels_per_second(_frame(spark)))
    assert len(found) == 1 and "base" in found[0]


def test_pivot_keeps_every_instant_apart(spark):
    half = timedelta(microseconds=500_000)
    at = [T0 + timedelta(seconds=i) for i in range(6)] + [T0 + half, T0 + half + timedelta(seconds=1), datetime(1960, 1, 1, 0, 0, 3), None]
    rows = [(house, ts, name, "GpmTimes100", 100.0 * n + extra)
            for house in ("h1", None) for n, ts in enumerate(at) for extra in (0.0, 50.0) for name in ("dist-flow", "primary-flow")]
    rows += [("h1", T0 + timedelta(seconds=9), "dist-flow", "odd", 1.0), ("h1", T0 + timedelta(seconds=10), "dist-swt", "WaterTempCTimes1000", None)]
    out = telemetry.pivot_channels_per_second(spark.createDataFrame(rows, schemas.READINGS_1S))
    got = {(r.house_alias, r.ts): (r.dist_flow_gpm, r.primary_flow_gpm, r.dist_swt_c) for r in out.collect()}
    want = {(house, ts): (n + 0.25, n + 0.25, None) for house in ("h1", None) for n, ts in enumerate(at)}
    want |= {("h1", T0 + timedelta(seconds=s)): (None, None, None) for s in (9, 10)}
    assert got == want and out.count() == len(want)
    assert dict(out.dtypes)["ts"] == "timestamp_ntz"


def test_local_time_looks_up_its_zone_once(spark):
    zone = "America/New_York"
    at = [datetime(2024, 3, 10, 6, 59, 59), datetime(2024, 3, 10, 7), datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 3, 6, 30),
          datetime(1880, 1, 1), datetime(1960, 7, 1, 0, 0, 0, 1), None]
    frame = spark.createDataFrame([(t,) for t in at], "ts timestamp_ntz")
    out = frame.select(
        local_time(F.col("ts"), zone).alias("a"), F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts")).alias("b"))
    assert out.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and dict(out.dtypes)["a"] == "timestamp_ntz"
    assert "convert_timezone" not in plan(frame.select(local_hour(F.col("ts"), zone))).lower()


def test_tasks_of_made_readings_grow_with_the_events(spark, monkeypatch):
    events = spark.range(0, 50).select(
        F.col("id").alias("event_id"), F.lit(T0).cast("timestamp").alias("ts"), F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.col("id").cast("string").alias("props"))
    monkeypatch.setattr(adapters, "EVENTS_PER_TASK", 2)
    readings = adapters.readings_1s_from_events(events)
    assert "hashpartitioning(event_id" in plan(readings) and ", 25)" in plan(readings)
    assert readings.count() == 50 * 40 * 6
    # the pattern match stands below both explodes: done once an event
    text = plan(readings)
    assert text.rindex("Generate") < text.index("regexp_extract")


def test_shuffles_begin_finer_than_their_setting(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        configure(spark)
        named = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert int(spark.conf.get(key)) == max(named, min(16 * named, 1000))
        spark.conf.set(key, "7")
        assert configure(spark).conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_origins_are_not_broadcast_and_fits_are_dealt(spark):
    origins = spark.createDataFrame([("h1", T0.date(), T0)], "house_alias string, day date, origin timestamp_ntz")
    fits = spark.createDataFrame(
        [("h1", 7, T0.date() - timedelta(days=2), 1.0, [1.0], [1.0])],
        "house_alias string, n int, fit_day date, energy_ratio double, coefficients array<double>, baseline_coefficients array<double>")
    joined = B.asof_fit(origins, fits)
    text = plan(joined)
    assert "SortMergeJoin [house_alias" in text and "REPARTITION_BY_NUM" in text
    assert [(r.origin, r.fit_day) for r in joined.collect()] == [(T0, T0.date() - timedelta(days=2))]
