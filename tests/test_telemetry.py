import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from hearthline import schemas
from hearthline.operators import forecast, merge, sensors, telemetry
from hearthline.plans import pipeline
from hearthline.sources import readers

UTC0 = datetime(2024, 1, 1, 5)  # midnight in New York


def seconds_frame(spark, flows, start=UTC0, house="h1"):
    rows = [
        (house, start + timedelta(seconds=i), 0.0 if g is None else 1.0, 50.0, 45.0, g, 40.0 + i % 2, 35.0)
        for i, g in flows.items()
    ]
    return spark.createDataFrame(
        rows,
        "house_alias string, ts timestamp_ntz, primary_flow_gpm double, hp_lwt_c double, hp_ewt_c double, "
        "dist_flow_gpm double, dist_swt_c double, dist_rwt_c double",
    )


def eligible(frame, cfg, start=UTC0):
    out = telemetry.flow_segments(frame, start, cfg)
    return sorted(int((r.ts - start).total_seconds()) for r in out.where("eligible").collect())


def test_onset_delay_and_segment_breaks(spark, cfg):
    flows = {i: 1.0 for i in range(0, 40)}
    flows[40] = 0.0                                   # dry second
    flows |= {i: 1.0 for i in range(41, 71)}          # exactly 30 seconds: none eligible
    flows |= {i: 1.0 for i in range(80, 112)}         # starts after a hole
    assert eligible(seconds_frame(spark, flows), cfg) == [*range(30, 40), 110, 111]


def test_unknown_flow_breaks_a_segment(spark, cfg):
    flows = {i: (None if i == 20 else 1.0) for i in range(60)}
    assert eligible(seconds_frame(spark, flows), cfg) == list(range(51, 60))


def test_batch_edge_restarts_the_onset(spark, cfg):
    edge = cfg.batch_days * 86400
    flows = {i: 1.0 for i in range(edge - 40, edge + 40)}
    assert eligible(seconds_frame(spark, flows), cfg) == [*range(edge - 10, edge), *range(edge + 30, edge + 40)]


def test_hourly_results_of_one_pass_equal_the_separate_ones(spark, cfg):
    readings = []
    random.seed(1)
    for i in range(0, 7200, 7):
        for channel, unit, low, high in (
            ("dist-flow", "GpmTimes100", 0, 300), ("primary-flow", "GpmTimes100", 100, 300),
            ("dist-swt", "WaterTempCTimes1000", 40000, 50000), ("dist-rwt", "WaterTempCTimes1000", 30000, 40000),
            ("hp-lwt", "WaterTempCTimes1000", 45000, 50000), ("hp-ewt", "WaterTempCTimes1000", 40000, 45000),
        ):
            for j in range(3):
                readings.append(("h1", UTC0 + timedelta(seconds=i + j), channel, unit, float(random.randint(low, high))))
    frame = spark.createDataFrame(readings, schemas.READINGS_1S)
    per_second = telemetry.pivot_channels_per_second(frame)
    segments = telemetry.flow_segments(per_second, UTC0, cfg)
    together = {r.hour_start: r for r in telemetry.hourly_from_seconds(frame, UTC0, cfg).collect()}
    for part in (telemetry.hourly_energy(per_second, cfg), telemetry.hourly_water_kg(per_second, cfg),
                 telemetry.hourly_flow_temps(segments, cfg)):
        for row in part.collect():
            for name in set(part.columns) - {"house_alias", "hour_start"}:
                assert together[row.hour_start][name] == row[name]


@pytest.mark.parametrize("since", [datetime(2024, 1, 10, 5), datetime(2025, 10, 30, 4), datetime(2026, 3, 5, 5)])
def test_runs_across_hours_batches_and_clock_changes(spark, cfg, since):
    """One pass by hour equals segments over whole batches, whatever edge a run crosses."""
    rng = random.Random(since.year)
    last = datetime(2025, 11, 2, 8) if since.year == 2025 else datetime(2026, 3, 8, 9) if since.year == 2026 else since + timedelta(days=5, hours=1)
    rows = []
    for hours in range(8):
        edge = last - timedelta(hours=hours)
        flowing = True
        for second in range(-90, 90):
            if rng.random() < 0.02:
                flowing = not flowing
            ts = edge + timedelta(seconds=second)
            rows.append(("h1", ts, "dist-flow", "GpmTimes100", 100.0 if flowing else 0.0))
            rows.append(("h1", ts, "dist-swt", "WaterTempCTimes1000", float(rng.randint(40000, 50000))))
    frame = spark.createDataFrame(rows, schemas.READINGS_1S)
    segments = telemetry.flow_segments(telemetry.pivot_channels_per_second(frame), since, cfg)
    wanted = {r.hour_start: r.swt_average_f for r in telemetry.hourly_flow_temps(segments, cfg).collect()}
    got = {r.hour_start: r.swt_average_f for r in telemetry.hourly_from_seconds(frame, since, cfg).collect()}
    assert len(wanted) > 6 and {h: got[h] for h in wanted} == wanted
    assert all(v is None for h, v in got.items() if h not in wanted)


def test_readings_with_the_wrong_unit_do_not_count(spark, cfg):
    rows = [("h1", UTC0, "dist-flow", "Gpm", 5.0), ("h1", UTC0, "dist-flow", "GpmTimes100", 100.0)]
    out = telemetry.pivot_channels_per_second(spark.createDataFrame(rows, schemas.READINGS_1S)).first()
    assert out.dist_flow_gpm == 1.0 and out.dist_swt_c is None


def test_energy_without_temperatures_is_zero(spark, cfg):
    rows = [("h1", UTC0, "dist-flow", "GpmTimes100", 100.0)]
    frame = telemetry.pivot_channels_per_second(spark.createDataFrame(rows, schemas.READINGS_1S))
    out = telemetry.hourly_energy(frame, cfg).first()
    assert (out.dist_kwh, out.hp_kwh_th) == (0.0, 0.0)


def test_local_hours_on_clock_changes(spark, cfg):
    autumn = datetime(2025, 11, 2, 4)   # midnight local; 05:00 and 06:00 UTC are both 01:00 local
    rows = [("h1", autumn + timedelta(hours=h), "dist-flow", "GpmTimes100", 6000.0) for h in range(5)]
    frame = telemetry.pivot_channels_per_second(spark.createDataFrame(rows, schemas.READINGS_1S))
    water = {r.hour_start.hour: r.dist_water_kg for r in telemetry.hourly_water_kg(frame, cfg).collect()}
    assert water == {0: 3.79, 1: 7.57, 2: 3.79, 3: 3.79}
    spring = datetime(2026, 3, 8, 5)
    rows = [("h1", spring + timedelta(hours=h), "dist-flow", "GpmTimes100", 6000.0) for h in range(5)]
    frame = telemetry.pivot_channels_per_second(spark.createDataFrame(rows, schemas.READINGS_1S))
    assert sorted(r.hour_start.hour for r in telemetry.hourly_water_kg(frame, cfg).collect()) == [0, 1, 3, 4, 5]


def named(spark, readings, channel="oil-boiler-pwr", unit="PowerW"):
    return spark.createDataFrame(
        [("h1", channel, unit, ts, v) for ts, v in readings],
        "house_alias string, channel_name string, unit string, ts timestamp_ntz, value double",
    )


def plain_locf(readings):
    """Straight loop over one hour: each value holds until the next instant."""
    lowest = {}
    for ts, v in readings:
        lowest[ts] = min(v, lowest.get(ts, v))
    points = sorted(lowest.items())
    area = sum(v * (b - a).total_seconds() for (a, v), (b, _) in zip(points, points[1:]))
    span = (points[-1][0] - points[0][0]).total_seconds()
    return area / span if span else None


@pytest.mark.parametrize("slice_seconds", [1, 60, 3600])
def test_time_weighting_is_the_same_for_every_slice_width(spark, cfg, slice_seconds):
    random.seed(7)
    readings = [
        (UTC0 + timedelta(microseconds=random.randint(0, 7_199_999_999)), float(random.randint(0, 500)))
        for _ in range(300)
    ]
    readings += readings[:40] + [(ts, v + 1) for ts, v in readings[40:60]]   # copies and ties
    out = sensors.time_weighted_avg_locf(named(spark, readings), cfg.with_(locf_slice_seconds=slice_seconds))
    got = {r.hour_start.hour: r.avg_value for r in out.collect()}
    for hour in (0, 1):
        mine = [(ts, v) for ts, v in readings if (ts - UTC0) // timedelta(hours=1) == hour]
        assert got[hour] == pytest.approx(plain_locf(mine), rel=1e-12)


def test_one_hot_instant_and_a_lone_reading(spark, cfg):
    readings = [(UTC0, 5.0)] * 500 + [(UTC0 + timedelta(hours=1), 7.0), (UTC0 + timedelta(hours=1, minutes=30), 9.0)]
    out = sensors.oil_boiler_hourly(named(spark, readings), cfg)
    assert {r.hour_start.hour: r.oil_boiler_pwr for r in out.collect()} == {0: 0.0, 1: 7.0}


def test_zone_sensors_are_averaged_after_rounding(spark, cfg):
    def pair(v):
        return [(UTC0, v), (UTC0 + timedelta(minutes=10), v)]

    frames = [
        named(spark, pair(67040.0), "zone1-down-temp", "AirTempFTimes1000"),
        named(spark, pair(68.26), "zone1-up-temp", "AirTempF"),
        named(spark, pair(10.0), "zone1-down-gw-temp", "AirTempF"),
        named(spark, pair(68000.0), "zone1-down-set", "AirTempFTimes1000"),
        named(spark, [(UTC0, 1.0)], "zone2-x-heat-call", "Binary"),
        named(spark, pair(1.0), "zonex-heat-call", "Binary"),
    ]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    out = {r.zone: r for r in sensors.zone_hourly(rows, cfg).collect()}
    # 67.0 and 68.3 average to 67.65, rounded up
    assert (out[1].avg_temp, out[1].avg_set, out[1].heatcall_fraction) == (67.7, 68.0, None)
    assert out[2].heatcall_fraction is None and len(out) == 2


def messages(spark, rows):
    return spark.createDataFrame(
        rows, "house_alias string, ts timestamp_ntz, Time array<string>, OatF array<double>, WindSpeedMph array<double>")


def test_forecast_as_of_each_hour(spark, cfg):
    rows = [
        ("h1", UTC0, ["a"] * 50, [float(i) for i in range(50)], [1.0] * 50),            # at the exact hour
        ("h1", UTC0 + timedelta(minutes=90), ["a"] * 3, [7.04, 8.0, 9.0], [2.0, 3.0]),    # cut to two
        ("h1", UTC0 + timedelta(minutes=100), [], [1.0], [1.0]),                         # unusable
        ("h1", UTC0 + timedelta(minutes=100), ["a"], [1.0], None),                       # unusable
    ]
    kept = forecast.dedupe_forecasts(messages(spark, rows), cfg)
    assert kept.count() == 2
    local0 = datetime(2024, 1, 1)
    hours = spark.createDataFrame(
        [("h1", local0 + timedelta(hours=h)) for h in (-1, 0, 1, 2, 500)] + [("h2", local0)],
        "house_alias string, hour_start timestamp_ntz")
    out = {(r.house_alias, int((r.hour_start - local0).total_seconds() // 3600)): r
           for r in forecast.asof_forecast(hours, kept, cfg).collect()}
    assert out["h1", -1].oat_f is None and out["h2", 0].oat_f is None
    assert out["h1", -1].oat_f_forecast == [None] * 48
    assert out["h1", 0].oat_f == 0.0 and out["h1", 1].oat_f_forecast[47] == 47.0
    assert out["h1", 2].oat_f == 7.0 and out["h1", 2].oat_f_forecast[:3] == [7.0, 8.0, None]
    assert out["h1", 500].oat_f == 7.0     # however old


def test_two_messages_at_one_local_time_in_autumn(spark, cfg):
    first, second = datetime(2025, 11, 2, 5, 30), datetime(2025, 11, 2, 6, 30)
    rows = [("h1", second, ["a"], [2.0], [2.0]), ("h1", first, ["a"], [1.0], [1.0]), ("h1", first, ["a"], [1.0], [1.0])]
    out = forecast.dedupe_forecasts(messages(spark, rows), cfg).collect()
    assert [r.oat for r in out] == [[1.0]]


def test_message_scan_reaches_back_and_ends_half_open(spark, cfg):
    end = UTC0 + timedelta(days=1)
    stamps = [UTC0 - timedelta(hours=48, seconds=1), UTC0 - timedelta(hours=48), end - timedelta(seconds=1), end]
    rows = [(ts, "weather.forecast", "H1 ", '{"Time":["x"],"OatF":[1.5],"WindSpeedMph":[2]}') for ts in stamps]
    rows.append((UTC0, "other", "h1", "{}"))
    frame = spark.createDataFrame(rows, schemas.MESSAGES)
    out = readers.scan_forecast_messages(frame, UTC0, end, cfg, houses=["h1"])
    assert [r.ts for r in out.orderBy("ts").collect()] == stamps[1:3]
    assert readers.scan_forecast_messages(frame, UTC0, end, cfg, houses=["h2"]).count() == 0


def test_build_hourly_fills_the_skeleton_with_defaults(spark, cfg):
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 1, 4)
    r1s = spark.createDataFrame(
        [("h1", UTC0 + timedelta(hours=1, seconds=s), c, u, v) for s in range(40) for c, u, v in (
            ("dist-flow", "GpmTimes100", 200.0), ("dist-swt", "WaterTempCTimes1000", 50000.0),
            ("dist-rwt", "WaterTempCTimes1000", 45000.0))], schemas.READINGS_1S)
    channels = spark.createDataFrame(
        [(1, "zone2-main-temp", "AirTempFTimes1000", "h1"), (2, "oil-boiler-pwr", "PowerW", "h1")], schemas.READING_CHANNELS)
    readings = spark.createDataFrame(
        [(1, UTC0 + timedelta(hours=2), 70000.0), (1, UTC0 + timedelta(hours=2, minutes=5), 71000.0),
         (2, UTC0 + timedelta(hours=2), 10.0)], schemas.READINGS)
    messages_ = spark.createDataFrame(
        [(UTC0 - timedelta(hours=3), "weather.forecast", "h1", '{"Time":["x","y"],"OatF":[20.55,21],"WindSpeedMph":[3,4]}')],
        schemas.MESSAGES)
    houses = spark.createDataFrame([("h1",), ("h2",)], "house_alias string")
    out = pipeline.build_hourly(r1s, readings, channels, messages_, houses, start, end, cfg)
    assert out.columns == list(schemas.HOURLY_COLUMNS)
    rows = {(r.house_alias, r.hour_start.hour): r for r in out.collect()}
    assert len(rows) == 8
    kwh = round(500 * 2 * 5 * 9 / 5 / 3410, 2)
    assert (rows["h1", 1].dist_kwh, rows["h1", 1].hp_kwh_th, rows["h1", 1].swt_average_f) == (kwh, 0.0, 122.0)
    assert rows["h1", 1].dist_water_kg == round(40 * 2 * 3.785411784 / 60, 2)
    assert rows["h1", 0].dist_kwh == 0.0 and rows["h1", 0].dist_water_kg is None
    assert tuple(rows["h1", 2].zones[0]) == (2, None, 70.0, 0.0)
    assert tuple(rows["h1", 3].zones[0]) == (2, None, None, 0.0)
    assert rows["h1", 2].oil_boiler_pwr == 0.0
    assert rows["h1", 3].oat_f == 20.6 and rows["h1", 3].ws_mph_forecast[:3] == [3.0, 4.0, None]
    assert rows["h2", 0].zones == [] or rows["h2", 0].zones is None
    assert rows["h2", 0].oat_f is None


def test_wall_clock_skeleton_has_every_hour_on_clock_change_days(spark, cfg):
    houses = spark.createDataFrame([("h1",)], "house_alias string")
    spring = merge.expected_hours(houses, datetime(2026, 3, 8), datetime(2026, 3, 9))
    autumn = merge.expected_hours(houses, datetime(2025, 11, 2), datetime(2025, 11, 3))
    assert spring.count() == 24 == autumn.count()


@pytest.mark.parametrize("start, day", [(datetime(2025, 11, 1, 4), datetime(2025, 11, 6)), (datetime(2026, 3, 6, 5), datetime(2026, 3, 11))])
def test_batch_edges_stay_at_local_midnight(spark, cfg, start, day):
    zone = ZoneInfo(cfg.timezone)
    edge = day.replace(tzinfo=zone).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
    frame = spark.createDataFrame([("h", edge + timedelta(seconds=k), 1.0) for k in (-1, 0)], "house_alias string, ts timestamp_ntz, dist_flow_gpm double")
    out = telemetry.flow_segments(frame, start, cfg).orderBy("ts").collect()
    assert [r.batch for r in out] == [0, 1]
