import random
from datetime import timedelta

from heat_rows import T0, hour_row, hourly, zone

from hearthline.plans.run import run


def test_a_run_writes_every_table_and_isolates_bad_houses(spark, cfg, tmp_path):
    random.seed(2)
    rows = [
        hour_row(i, house="good", oat_f=random.uniform(10, 30), dist_kwh=random.uniform(1, 9), hp_kwh_th=random.uniform(1, 9),
                 ws_mph=random.uniform(0, 9), solar_w_m2=random.uniform(0, 300), swt_average_f=random.uniform(100, 130),
                 zones=[zone(heatcall=random.uniform(0.6, 1.0), avg_temp=68 + random.uniform(-0.5, 0.5))])
        for i in range(24 * 14)
    ]
    rows += [hour_row(i, house="cold", oil_boiler_pwr=500.0) for i in range(48)]
    houses = spark.createDataFrame([(" Good",), ("cold",), ("absent",)], "house_alias string")
    rows += [hour_row(i, house="not asked for") for i in range(48)]
    run(houses, hourly(spark, rows), None, T0, T0 + timedelta(days=14), str(tmp_path), 7, cfg, backtest_n=4, sweep=(3, 4))
    read = lambda name: spark.read.parquet(str(tmp_path / "result_7" / name))
    status = {r.house_alias: r for r in read("house_status").collect()}
    assert status["good"].energy_status == status["good"].rswt_status == status["good"].backtest_status == "ok"
    assert status["cold"].energy_status == "no_usable_rows" and status["absent"].rswt_status == "no_hourly_data"
    for name in ("in_sample_metrics", "error_histogram", "rswt_curve", "water_line", "trailing_points"):
        assert {r.house_alias for r in read(name).select("house_alias").collect()} == {"good"}
    for name in ("cleaning_report", "channel_distribution"):
        assert {r.house_alias for r in read(name).select("house_alias").collect()} == {"good", "cold"}
    for name in ("energy_params", "rswt_params", "trailing_params", "trailing_metrics", "sweep_n"):
        assert {r.house_alias for r in read(name).select("house_alias").collect()} == {"good"}
    assert read("trailing_rmse_by_lead").count() == 48
    assert spark.read.json(str(tmp_path / "result_7" / "run_parameters")).count() == 3
