from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline import HeatConfig
from hearthline.operators import regression as R
from hearthline.plans import pipeline
from hearthline.sources import writers

T0 = datetime(2024, 1, 1)
FIELDS = ("house_alias string, hour_start timestamp_ntz, day date, oat_f double, ws_mph double, temp_avg double, "
          "deltaT double, windspeed_times_deltaT double, windspeed_times_65_minus_oat double, solar_w_m2 double, "
          "previous_dist_kwh double, OAT_avg_4h double, dist_kwh_avg_4h double, dist_kwh double, hp_kwh_th double, "
          "oat_f_forecast array<double>, ws_mph_forecast array<double>")
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
COEF = np.array([0.5, 0.04, 0.001, -0.002, 0.4, -0.01, 0.2])


def planted(house="h1", days=30, noise=0.05, seed=3, ratio=1.1, skip_days=(), forecasts=False, solar=True):
    """Feature rows of a house that follows known coefficients."""
    rng = np.random.default_rng(seed)
    rows, history = [], [3.0, 3.1, 2.9, 3.2]
    for i in range(days * 24):
        stamp = T0 + timedelta(hours=i)
        if (stamp.date() - T0.date()).days in skip_days:
            continue
        oat, wind, sun = rng.uniform(0, 50), rng.uniform(0, 20), rng.uniform(0, 400) if solar else 0.0
        temp, oat4 = rng.uniform(66, 70), rng.uniform(0, 50)
        dt = max(0.0, temp - oat)
        load4 = float(np.mean(history[-4:])) + rng.uniform(-1, 1)
        scaled = COEF @ [1, dt, wind * dt, sun, history[-1] * ratio, oat4, load4 * ratio] + rng.normal(0, noise)
        load = float(max(0.05, scaled / ratio))
        fc = [float(x) for x in rng.uniform(0, 50, 48)] if forecasts and i % 3 else None
        if fc and i % 5 == 0:
            fc[3] = None
        ws = [float(x) for x in rng.uniform(0, 20, 48 if i % 4 else 20)] if fc else None
        rows.append((house, stamp, stamp.date(), oat, wind, temp, dt, wind * dt, wind * (65 - oat), sun, history[-1],
                     oat4, load4, load, load * ratio, fc, ws))
        history.append(load)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def plain_fit(rows, names, scaled):
    """Least squares on the rows of one window, written out with numpy."""
    column = lambda name: np.array([r[NAMES.index(name)] for r in rows], dtype=float)
    ratio = column("hp_kwh_th").sum() / column("dist_kwh").sum()
    x = np.column_stack([np.ones(len(rows))] + [column(n) * (ratio if s else 1) for n, s in zip(names, scaled)])
    y = column("dist_kwh") * ratio
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    variance = residual @ residual / max(len(y) - np.linalg.matrix_rank(x), 1)
    errors = np.sqrt(variance * np.diag(np.linalg.pinv(x.T @ x)))
    return ratio, beta, errors, 1 - residual @ residual / ((y - y.mean()) ** 2).sum()


MAIN = (["deltaT", "windspeed_times_deltaT", "solar_w_m2", "previous_dist_kwh", "OAT_avg_4h", "dist_kwh_avg_4h"],
        [False, False, False, True, False, True])
BASE = (["oat_f", "windspeed_times_65_minus_oat"], [False, False])


def test_planted_coefficients_are_recovered(spark, cfg):
    out = pipeline.energy_params(frame(spark, planted(days=60)), cfg).first()
    assert out.energy_ratio == pytest.approx(1.1, abs=1e-3)
    assert np.allclose(out.coefficients, COEF, atol=0.03)
    assert out.r_squared > 0.98 and out.well_posed


def test_fit_matches_numpy_for_both_models_and_last_n_days(spark, cfg):
    rows = planted(days=20, skip_days=(15, 16))
    for n in (None, 6, 400):
        days = sorted({r[2] for r in rows})[-(n or 400):]
        window = [r for r in rows if r[2] in days]
        out = pipeline.energy_params(frame(spark, rows), cfg, n=n).first()
        assert out.n_days == (n or 18) and out.n_hours == len(window)
        for (names, scaled), prefix in ((MAIN, ""), (BASE, "baseline_")):
            ratio, beta, errors, r2 = plain_fit(window, names, scaled)
            assert out.energy_ratio == pytest.approx(ratio, abs=5e-4)
            assert np.allclose(out[f"{prefix}coefficients"], beta, atol=1.1e-6)
            assert np.allclose(out[f"{prefix}std_errors"], errors, atol=1.1e-6)
            assert out[f"{prefix}r_squared"] == pytest.approx(r2, abs=6e-4)


def test_all_zero_column_gets_zero_and_no_errors(spark, cfg):
    rows = planted(solar=False)
    out = pipeline.energy_params(frame(spark, rows), cfg).first()
    _, beta, _, _ = plain_fit(rows, *MAIN)
    assert out.coefficients[3] == 0.0
    assert np.allclose(out.coefficients, beta, atol=1.1e-6)
    assert out.std_errors == [None] * 7
    assert all(e is not None for e in out.baseline_std_errors)


def test_collinear_columns_get_the_minimum_norm_fit(spark, cfg):
    at = NAMES.index
    rows = [list(r) for r in planted(days=12)]
    for r in rows:
        r[at("OAT_avg_4h")] = 2 * r[at("deltaT")]        # exact multiple
        r[at("solar_w_m2")] = 100.0                      # constant, like the intercept
    rows = [tuple(r) for r in rows]
    good = planted("h2", days=12, seed=9)
    out = {r.house_alias: r for r in pipeline.energy_params(frame(spark, rows + good), cfg).collect()}
    _, beta, _, r2 = plain_fit(rows, *MAIN)
    assert np.allclose(out["h1"].coefficients, beta, atol=1e-5)
    assert out["h1"].std_errors == [None] * 7
    assert out["h1"].r_squared == pytest.approx(r2, abs=6e-4)
    assert np.allclose(out["h2"].coefficients, plain_fit(good, *MAIN)[1], atol=1.1e-6)


def test_fewer_rows_than_coefficients(spark, cfg):
    rows = planted(days=1)[:5]
    out = pipeline.energy_params(frame(spark, rows), cfg).first()
    assert np.allclose(out.coefficients, plain_fit(rows, *MAIN)[1], atol=1e-5)
    assert out.std_errors == [None] * 7


def test_constant_load_has_r_squared_one(spark, cfg):
    at = NAMES.index
    rows = [list(r) for r in planted(days=5)]
    for r in rows:
        r[at("dist_kwh")] = r[at("hp_kwh_th")] = 2.0
    out = pipeline.energy_params(frame(spark, [tuple(r) for r in rows]), cfg).first()
    assert out.baseline_coefficients[0] == pytest.approx(2.0, abs=1e-6)


def test_no_load_gives_no_parameters_and_spares_other_houses(spark, cfg):
    at = NAMES.index
    idle = [list(r) for r in planted("idle", days=3)]
    for r in idle:
        r[at("dist_kwh")] = 0.0
    rows = [tuple(r) for r in idle] + planted("busy", days=12)
    out = {r.house_alias: r for r in pipeline.energy_params(frame(spark, rows), cfg).collect()}
    assert out["idle"].energy_ratio is None and set(out["idle"].coefficients) == {None}
    assert out["busy"].well_posed


def test_a_house_without_zones_has_no_fit_and_spares_others(spark, cfg):
    at = NAMES.index
    bare = [list(r) for r in planted("bare", days=3)]
    for r in bare:
        r[at("temp_avg")] = r[at("deltaT")] = r[at("windspeed_times_deltaT")] = None
    features = frame(spark, [tuple(r) for r in bare] + planted("whole", days=12))
    params = pipeline.energy_params(features, cfg)
    out = {r.house_alias: r for r in params.collect()}
    assert set(out["bare"].coefficients) == {None} and out["whole"].well_posed
    assert {r.house_alias for r in R.predict(features, params, cfg).collect()} == {"whole"}


def test_occupancy_indicators_enter_the_fit(spark):
    cfg = HeatConfig(include_occupancy=True)
    from hearthline.operators.features import occupancy_dummies, occupancy_index

    base = frame(spark, planted(days=28))
    bump = F.when((F.hour("hour_start") == 7) & (F.weekday("hour_start") < 5), 1.0).otherwise(0.0)
    rows = occupancy_dummies(base.withColumn("dist_kwh", F.col("dist_kwh") + bump)
                             .withColumn("hp_kwh_th", F.col("hp_kwh_th") + bump * 1.1))
    out = pipeline.energy_params(rows, cfg).first()
    names = dict(zip(("intercept", *cfg.feature_names), out.coefficients))
    assert len(out.coefficients) == 37 and names["wd_hour_7"] > 0.9
    place = rows.select(occupancy_index(F.col("hour_start")).alias("i"), "hour_start").collect()
    for r in place[:200]:
        hour, weekend = r.hour_start.hour, r.hour_start.weekday() >= 5
        name = f"{'we' if weekend else 'wd'}_hour_{hour}"
        assert (r.i is None) == (name not in cfg.feature_names)
        if r.i is not None:
            assert cfg.feature_names[r.i] == name


def test_parameter_table_columns(spark, cfg):
    table = writers.energy_params_table(pipeline.energy_params(frame(spark, planted(days=12)), cfg), cfg)
    assert table.columns[:4] == ["house_alias", "n_days", "intercept", "std_error_intercept"]
    assert table.columns[-2:] == ["r_squared", "energy_ratio"]


def test_in_sample_metrics_match_a_loop(spark, cfg):
    rows = planted(days=12, noise=0.5)
    features = frame(spark, rows)
    params = pipeline.energy_params(features, cfg)
    p, out = params.first(), R.in_sample_metrics(features, params, cfg).first()
    at = lambda r, n: r[NAMES.index(n)]
    errors, base = [], []
    for r in rows:
        x = [1] + [at(r, n) * (p.energy_ratio if s else 1) for n, s in zip(*MAIN)]
        actual = at(r, "dist_kwh") * p.energy_ratio
        errors.append(max(0, np.dot(x, p.coefficients)) - actual)
        xb = [1] + [at(r, n) for n in BASE[0]]
        base.append(max(0, np.dot(xb, p.baseline_coefficients)) - actual)
    assert out.n_points == len(rows)
    assert out.mae == pytest.approx(np.abs(errors).mean()) and out.rmse_baseline == pytest.approx(np.sqrt(np.mean(np.square(base))))


def test_histogram_edges(spark):
    points = spark.createDataFrame(
        [("h1", e, 0.0, 0.0) for e in (-6.0, -5.81, 0.0, 5.99, 6.0, 6.01, -6.01)],
        "house_alias string, predicted double, actual double, predicted_baseline double")
    out = R.error_histogram(points, ["house_alias"]).where("model = 'model'").collect()
    assert {r.bin: r.n for r in out} == {1: 2, 31: 1, 60: 2}


def test_days_are_dates(spark, cfg):
    moments = R.ols_moments(frame(spark, planted(days=3)), cfg)
    assert {r.day for r in moments.collect()} == {date(2024, 1, d) for d in (1, 2, 3)}
