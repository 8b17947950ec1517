"""Plan shapes that matter at scale."""

from datetime import timedelta

from heat_rows import hour_row, hourly

from hearthline.operators import sensors, telemetry
from hearthline.plans import pipeline
from hearthline.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def test_cleaning_and_features_need_one_shuffle(spark, cfg, tmp_path):
    hourly(spark, [hour_row(i) for i in range(30)]).write.parquet(str(tmp_path / "h"))
    features = pipeline.prepare(spark.read.parquet(str(tmp_path / "h")), None, cfg)
    found = exchanges(features)
    assert len(found) == 1 and "hashpartitioning(house_alias" in found[0]


def test_scan_filters_and_columns_reach_the_reader(spark, cfg, tmp_path, capsys):
    from test_telemetry import UTC0

    rows = [("h1", UTC0, "dist-flow", "GpmTimes100", 1.0, "note")]
    frame = spark.createDataFrame(
        rows, "house_alias string, ts timestamp_ntz, channel_name string, unit string, value double, note string")
    frame.write.parquet(str(tmp_path / "r"))
    scan = readers.scan_readings_1s(spark.read.parquet(str(tmp_path / "r")), UTC0, UTC0 + timedelta(days=1), telemetry.CHANNELS_READ)
    scan.explain("formatted")
    text = capsys.readouterr().out.splitlines()
    pushed = next(line for line in text if "PushedFilters" in line)
    assert "GreaterThanOrEqual(ts" in pushed and "In(channel_name" in pushed
    assert "note" not in next(line for line in text if "ReadSchema" in line)


def test_sensor_means_take_two_exchanges_and_no_window(spark, cfg):
    from test_telemetry import UTC0, named

    frame = sensors.time_weighted_avg_locf(named(spark, [(UTC0, 1.0)]), cfg)
    assert "Window" not in plan(frame) and "Sort " not in plan(frame)
    found = exchanges(frame)
    assert len(found) == 2 and sum("slice" in line for line in found) == 1
    assert plan(frame).count("partial_collect_") == 2  # both combine before they shuffle


def test_hourly_telemetry_takes_one_exchange(spark, cfg):
    from test_telemetry import UTC0

    from hearthline import schemas

    readings = spark.createDataFrame([("h1", UTC0, "dist-flow", "GpmTimes100", 1.0)], schemas.READINGS_1S)
    found = exchanges(telemetry.hourly_from_seconds(readings, UTC0, cfg))
    assert len(found) == 1 and "hashpartitioning(house_alias" in found[0] and "slot" in found[0]


def test_a_row_per_origin_reaches_the_metrics(spark, cfg):
    from test_backtest import frame, planted

    from hearthline.operators import backtest as B

    features = frame(spark, planted(days=4))
    fits = spark.createDataFrame(
        [], "house_alias string, n int, fit_day date, energy_ratio double, coefficients array<double>, baseline_coefficients array<double>")
    forecasts = B.forecasts(B.origin_lead_join(features, cfg), fits, cfg)
    spread = plan(forecasts).count("Generate")  # fits over the days they serve
    assert plan(B.oos_metrics(forecasts)).count("Generate") == spread
    by_lead = plan(B.rmse_by_lead(forecasts, cfg))
    assert by_lead.count("Generate") == spread + 1
    assert by_lead.index("Generate") < by_lead.index("HashAggregate")  # leads are spread above the means
    assert "targets" not in by_lead[:by_lead.index("HashAggregate")]
