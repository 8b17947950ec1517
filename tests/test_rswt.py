from datetime import datetime, timedelta

import numpy as np
import pytest

from hearthline.operators import rswt
from hearthline.plans import pipeline

T0 = datetime(2024, 1, 1)
ROWS = ("house_alias string, hour_start timestamp_ntz, day date, swt_average_f double, rwt_average_f double, "
        "dist_kwh double, dist_water_kg double, max_zone_heatcall double")
FEATURES = ROWS.replace("max_zone_heatcall double", "zones array<struct<zone:int,heatcall_fraction:double>>")


def row(i, load=1.0, swt=None, rwt=None, water=500.0, heatcall=0.5, house="h1"):
    stamp = T0 + timedelta(hours=i)
    swt = 100.0 + i % 17 if swt is None else swt
    return (house, stamp, stamp.date(), swt, 20 + 0.7 * swt if rwt is None else rwt, load, water, heatcall)


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def test_band_edges_and_minimum_rows(spark, cfg):
    loads = [0.0] * 10 + [1.999] * 9 + [2.0] * 20 + [4.0] * 21 + [8.0] * 10 + [25.0] * 10
    out = {r.band: r for r in rswt.fit_rswt_bands(rows(spark, [row(i, x) for i, x in enumerate(loads)]), cfg).collect()}
    assert {b: r.n_hours for b, r in out.items()} == {"load_0_2": 19, "load_2_4": 20, "load_4_6": 21, "load_8_plus": 20}
    assert out["load_0_2"].rwt_slope is None
    assert (out["load_8_plus"].rwt_intercept, out["load_8_plus"].rwt_slope) == (20.0, 0.7)


def test_equal_supply_temperatures_give_the_minimum_norm_line(spark, cfg):
    data = [row(i, 1.0, swt=120.0, rwt=100.0 + i % 2) for i in range(20)]
    out = rswt.fit_rswt_bands(rows(spark, data), cfg).first()
    x = np.column_stack([np.ones(20), np.full(20, 120.0)])
    want, *_ = np.linalg.lstsq(x, np.array([100.0 + i % 2 for i in range(20)]), rcond=None)
    assert (out.rwt_intercept, out.rwt_slope) == pytest.approx(tuple(want), abs=1e-6)


def test_incomplete_rows_are_left_out(spark):
    data = [row(i) for i in range(4)]
    zones = [[(1, 0.2), (2, 0.9)], [(1, None), (2, 0.9)], [(1, 0.1)], [(1, 0.3)]]
    data = [d[:7] + (z,) for d, z in zip(data, zones)]
    data[2] = data[2][:4] + (None,) + data[2][5:]
    out = rswt.rswt_rows(spark.createDataFrame(data, FEATURES)).orderBy("hour_start").collect()
    assert [r.max_zone_heatcall for r in out] == [0.9, 0.3]


def water(spark, cfg, heatcalls, waters=None):
    waters = waters or [float(i) for i in range(len(heatcalls))]
    data = [row(i, heatcall=h, water=w) for i, (h, w) in enumerate(zip(heatcalls, waters))]
    return rswt.chc_water(rows(spark, data), cfg).first()


def test_water_pools(spark, cfg):
    enough = water(spark, cfg, [0.81] * 20 + [0.8] * 30)
    assert (enough.pool, enough.n_hours, enough.water_kg_hour_chc) == ("above_threshold", 20, 9.5)
    floor = water(spark, cfg, [0.9] * 19 + [0.75] * 5 + [0.1] * 30)
    # ties: the first of the five equal hours
    assert (floor.pool, floor.n_hours, floor.water_kg_hour_chc) == ("above_floor", 20, 9.5)
    every = water(spark, cfg, [0.1] * 30 + [0.6] * 10)
    assert (every.pool, every.water_kg_hour_chc) == ("all_hours", round((sum(range(30, 40)) + sum(range(10))) / 20, 2))
    few = water(spark, cfg, [0.2, 0.3, 0.4])
    assert (few.pool, few.n_hours, few.water_kg_hour_chc) == ("all_hours", 3, 1.0)


def test_water_ignores_missing_readings(spark, cfg):
    out = water(spark, cfg, [0.9] * 20, [None] * 19 + [7.0])
    assert (out.n_hours, out.water_kg_hour_chc) == (1, 7.0)
    nothing = water(spark, cfg, [0.9] * 20, [None] * 20)
    assert (nothing.n_hours, nothing.water_kg_hour_chc) == (0, None)


def test_parameters_curve_and_line(spark, cfg):
    data = [row(i, 1.0 + 2 * (i % 2), heatcall=0.9) for i in range(60)]
    data += [row(i, 1.0, house="tiny") for i in range(5)] + [row(i, 1.0, house="dry", water=None) for i in range(30)]
    zoned = spark.createDataFrame([d[:7] + ([(1, d[7])],) for d in data], FEATURES)
    result = pipeline.rswt_params(zoned, cfg)
    out = result.params.collect()
    assert [r.house_alias for r in out] == ["h1"]
    assert (out[0].rwt_min, out[0].water_kg_hour_chc, out[0].load_2_4_rwt_slope, out[0].load_8_plus_rwt_slope) == (
        50.0, 500.0, 0.7, None)
    curve = rswt.rswt_curve(result.rows, result.bands, cfg).where("house_alias = 'h1' AND band = 'load_0_2'")
    points = curve.orderBy("point").collect()
    assert len(points) == 100 and points[0].mid_load_kwh == 1.0
    assert np.allclose([p.swt_f for p in points], np.linspace(points[0].swt_f, points[-1].swt_f, 100))
    line = rswt.chc_water_line(result.water).where("house_alias = 'h1'").collect()
    assert sorted((r.heatcall_fraction, r.water_kg_hour) for r in line) == [(0.0, 0.0), (0.9, 500.0)]
    assert rswt.mid_loads(cfg) == {"load_0_2": 1.0, "load_2_4": 3.0, "load_4_6": 5.0, "load_6_8": 7.0, "load_8_plus": 9.0}


def test_last_days_count_days_of_the_features(spark, cfg):
    data = [row(i, heatcall=0.9) for i in range(96)]
    data = [d[:3] + (None,) + d[4:] if d[1].day == 4 else d for d in data]
    zoned = spark.createDataFrame([d[:7] + ([(1, d[7])],) for d in data], FEATURES)
    assert pipeline.rswt_params(zoned, cfg, n=2).rows.count() == 24
