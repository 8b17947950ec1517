from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_regression import BASE, MAIN, NAMES, frame, planted

from hearthline.operators import backtest as B
from hearthline.operators import sweep
from hearthline.plans import pipeline

DAY0 = date(2024, 1, 1)


def schedule(spark, cfg, days, n):
    frame_ = spark.createDataFrame([("h1", DAY0 + timedelta(days=d)) for d in days], "house_alias string, day date")
    rows = B.refit_schedule(frame_, F.lit(n), cfg).collect()
    return sorted((r.fit_day - DAY0).days for r in rows)


def test_weekly_refits_count_calendar_days_on_days_with_data(spark, cfg):
    days = [0, 1, 2, 5, 7, 8, 9, 15, 20]
    assert schedule(spark, cfg, days, 1) == [0, 7, 15]
    assert schedule(spark, cfg, days, 4) == [5, 15]
    assert schedule(spark, cfg, days, 10) == []
    assert schedule(spark, cfg.with_(training_frequency="daily"), days, 8) == [15, 20]
    growing = cfg.with_(grow_window=True, min_fit_days=2)
    assert schedule(spark, growing, days, 10) == [1, 8, 15]


def loop_backtest(rows, fits, horizon, use_forecasts=True):
    """Every origin and step one at a time."""
    at = lambda r, name: r[NAMES.index(name)]
    points = []
    for o in range(len(rows) - horizon):
        usable = [f for f in fits if f.fit_day < at(rows[o], "day")]
        if not usable:
            continue
        fit = max(usable, key=lambda f: f.fit_day)
        oat_fc, ws_fc = at(rows[o], "oat_f_forecast"), at(rows[o], "ws_mph_forecast")
        lag = at(rows[o], "previous_dist_kwh") * fit.energy_ratio
        for step in range(horizon):
            r = rows[o + step]
            oat, wind, dt = at(r, "oat_f"), at(r, "ws_mph"), at(r, "deltaT")
            if use_forecasts and oat_fc and ws_fc and step < min(len(oat_fc), len(ws_fc)):
                if oat_fc[step] is not None and ws_fc[step] is not None:
                    oat, wind = oat_fc[step], ws_fc[step]
                    dt = max(0.0, at(r, "temp_avg") - oat)
            x = [1, dt, wind * dt, at(r, "solar_w_m2"), lag, at(r, "OAT_avg_4h"), at(r, "dist_kwh_avg_4h") * fit.energy_ratio]
            lag = max(0.0, float(np.dot(x, fit.coefficients)))
            base = max(0.0, float(np.dot([1, oat, wind * (65 - oat)], fit.baseline_coefficients)))
            points.append((at(rows[o], "hour_start"), step + 1, lag, base, at(r, "dist_kwh") * fit.energy_ratio))
    return points


@pytest.mark.parametrize("use_forecasts", [True, False])
def test_forecasts_equal_a_plain_loop(spark, cfg, use_forecasts):
    cfg = cfg.with_(use_forecasts=use_forecasts)
    rows = planted(days=16, noise=0.6, forecasts=True, skip_days=(5,))
    result = pipeline.backtest(frame(spark, rows), 4, cfg)
    fits = result.fits.collect()
    assert sorted((f.fit_day - DAY0).days for f in fits) == [3, 10]
    expected = loop_backtest(rows, fits, cfg.horizon_hours, use_forecasts)
    got = sorted((r.origin, r.lead, r.predicted, r.predicted_baseline, r.actual) for r in result.points.collect())
    assert len(got) == len(expected) > 5000
    for g, e in zip(got, sorted(expected)):
        assert g[:2] == e[:2]
        assert g[2:] == pytest.approx(e[2:], abs=1e-9)
    error = np.array([g[2] - g[4] for g in got])
    metrics = result.metrics.first()
    assert metrics.rmse == pytest.approx(np.sqrt((error**2).mean())) and metrics.mae == pytest.approx(np.abs(error).mean())
    lead1 = [g for g in got if g[1] == 1]
    cells = {(r.weekend, r.hour): r for r in result.residuals.collect()}
    assert len(cells) == 48 and sum(c.n_points for c in cells.values()) == len(lead1)
    mine = np.array([g[2] - g[4] for g in lead1 if g[0].hour == 5 and g[0].weekday() < 5])
    assert cells[False, 5].mean_residual == pytest.approx(mine.mean())
    assert cells[False, 5].ci95 == pytest.approx(1.96 * mine.std(ddof=1) / np.sqrt(len(mine)))


def test_the_last_full_horizon_is_not_scored(spark, cfg):
    rows = planted(days=4)
    origins = B.origin_lead_join(frame(spark, rows), cfg)
    assert origins.count() == len(rows) - 48
    assert {len(r.targets) for r in origins.select("targets").collect()} == {48}


def test_short_history_scores_nothing(spark, cfg):
    result = pipeline.backtest(frame(spark, planted(days=3)), 10, cfg)
    assert result.fits.count() == 0 and result.points.count() == 0


def test_occupancy_terms_follow_the_target_hour(spark, cfg):
    from hearthline.operators.features import occupancy_dummies

    cfg = cfg.with_(include_occupancy=True)
    rows = planted(days=30, forecasts=True)
    result = pipeline.backtest(occupancy_dummies(frame(spark, rows)), 21, cfg)
    fit = result.fits.collect()[0]
    extra = dict(zip(cfg.feature_names[6:], fit.coefficients[7:]))
    got = result.points.where("lead = 1").orderBy("origin").first()
    r = next(x for x in rows if x[1] == got.origin)
    at = lambda n: r[NAMES.index(n)]
    use = at("oat_f_forecast") is not None
    oat = at("oat_f_forecast")[0] if use else at("oat_f")
    wind = at("ws_mph_forecast")[0] if use else at("ws_mph")
    dt = max(0.0, at("temp_avg") - oat)
    x = [1, dt, wind * dt, at("solar_w_m2"), at("previous_dist_kwh") * fit.energy_ratio, at("OAT_avg_4h"),
         at("dist_kwh_avg_4h") * fit.energy_ratio]
    kind = "we" if got.hour_start.weekday() >= 5 else "wd"
    want = np.dot(x, fit.coefficients[:7]) + extra.get(f"{kind}_hour_{got.hour_start.hour}", 0.0)
    assert got.predicted == pytest.approx(max(0.0, want), abs=1e-9)


@pytest.mark.parametrize("changes", [{}, {"grow_window": True, "min_fit_days": 3}, {"training_frequency": "daily"}])
def test_sweep_at_each_look_back_equals_the_single_backtest(spark, cfg, changes):
    cfg = cfg.with_(**changes)
    features = frame(spark, planted(days=14, forecasts=True) + planted("h2", days=9, seed=5))
    swept = {(r.house_alias, r.n): r for r in pipeline.sweep_n(features, 4, 6, cfg).collect()}
    all_fits = pipeline.sweep_fits(features, 4, 6, cfg).collect()
    for n in (4, 6):
        single = pipeline.backtest(features, n, cfg)
        key = lambda f: (f.house_alias, f.fit_day)
        mine = sorted((f for f in all_fits if f.n == n), key=key)
        for a, b in zip(mine, sorted(single.fits.collect(), key=key), strict=True):
            assert key(a) == key(b) and np.allclose(a.coefficients, b.coefficients, atol=2e-6)
            assert a.first_day == b.first_day and a.n_hours == b.n_hours
        for m in single.metrics.collect():
            assert swept[m.house_alias, n].rmse == pytest.approx(m.rmse, abs=1e-5)
            assert swept[m.house_alias, n].n_points == m.n_points


def test_windows_are_days_with_data(spark, cfg):
    rows = planted(days=12, skip_days=(3, 4))
    fits = {(f.fit_day - DAY0).days: f for f in pipeline.backtest_fits(frame(spark, rows), 5, cfg).collect()}
    assert sorted(fits) == [6]
    window = [r for r in rows if (r[2] - DAY0).days in (0, 1, 2, 5, 6)]
    from test_regression import plain_fit

    assert np.allclose(fits[6].coefficients, plain_fit(window, *MAIN)[1], atol=1.1e-6)
    assert np.allclose(fits[6].baseline_coefficients, plain_fit(window, *BASE)[1], atol=1.1e-6)


def test_coefficient_stability(spark, cfg):
    fits = spark.createDataFrame(
        [("h1", 5, DAY0 + timedelta(days=d), [0.0, b]) for d, b in ((0, 1.0), (3, 2.0), (6, 0.5), (9, 4.0))],
        "house_alias string, n int, fit_day date, coefficients array<double>")
    weekly = sweep.coef_stability(fits, cfg).first()
    assert weekly.stability == pytest.approx((1 + 1.5 + 3.5) / 3) and weekly.n_fits == 4
    daily = sweep.coef_stability(fits, cfg.with_(training_frequency="daily")).first()
    # trailing seven days: {1}, {1,2}, {1,2,0.5}, {2,0.5,4}
    assert daily.stability == pytest.approx((0 + 1 + 1.5 + 3.5) / 4)


def test_other_houses_change_nothing(spark, cfg):
    alone = pipeline.backtest(frame(spark, planted(days=12)), 4, cfg).metrics.first()
    both = pipeline.backtest(frame(spark, planted("h2", days=12, seed=8) + planted(days=12)), 4, cfg)
    assert both.metrics.where("house_alias = 'h1'").first() == alone
