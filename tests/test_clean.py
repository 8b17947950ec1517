import pytest
from heat_rows import by_hour, hour_row, hourly, zone

from hearthline.operators import clean


def audit(spark, cfg, rows):
    return clean.clean_audit(hourly(spark, rows), cfg)


def test_null_runs_of_three_are_filled_and_of_four_dropped(spark, cfg):
    holes = {10, 11, 12, 30, 31, 32, 33}
    rows = [hour_row(i, ws_mph=None if i in holes else float(i)) for i in range(48)]
    out = audit(spark, cfg, rows)
    gap, wind = by_hour(out, "gap_hour"), by_hour(out, "ws_mph")
    assert {i for i, g in gap.items() if g} == {30, 31, 32, 33}
    assert [wind[i] for i in (10, 11, 12)] == [10.0, 11.0, 12.0]
    assert wind[31] is None
    assert by_hour(out, "dropped_by")[31] == "long_gap"


def test_gap_of_one_channel_blocks_filling_of_others_but_not_of_outdoor_temperature(spark, cfg):
    rows = [
        hour_row(i, ws_mph=None if 20 <= i < 24 else 5.0, solar_w_m2=None if i == 21 else float(i),
                 oat_f=None if i == 21 else float(i))
        for i in range(40)
    ]
    out = audit(spark, cfg, rows)
    assert by_hour(out, "solar_w_m2")[21] is None
    assert by_hour(out, "oat_f")[21] == 21.0


def test_leading_nulls_stay_and_trailing_ones_repeat_the_last_value(spark, cfg):
    rows = [hour_row(i, ws_mph=None if i < 2 or i > 17 else float(i)) for i in range(20)]
    wind = by_hour(audit(spark, cfg, rows), "ws_mph")
    assert wind[0] is None and wind[1] is None
    assert wind[18] == wind[19] == 17.0


def test_missing_hours_are_inserted_and_filled_by_time(spark, cfg):
    rows = [hour_row(i, ws_mph=float(i)) for i in range(20) if i not in (8, 9)]
    out = audit(spark, cfg, rows)
    assert out.count() == 20
    assert by_hour(out, "ws_mph")[9] == 9.0
    assert by_hour(out, "inserted")[9]
    # an inserted hour was not observed, so hours after it have no load mean
    verdicts = by_hour(out, "dropped_by")
    assert [verdicts[i] for i in (12, 13, 14)] == ["no_rolling_mean", "no_rolling_mean", None]


def test_rate_of_change_compares_with_the_unfiltered_previous_row(spark, cfg):
    temps = [20.0, 46.0, 47.0, None, 20.0, 45.0]
    rows = [hour_row(i, oat_f=t) for i, t in enumerate(temps)]
    out = clean.rate_of_change_filter(hourly(spark, rows), cfg)
    # 46 jumps, 47 is near 46, the row after a null passes, a change of exactly 25 passes
    assert list(by_hour(out, "oat_f").values()) == [20.0, None, 47.0, None, 20.0, 45.0]


def test_rate_of_change_uses_the_previous_present_row_across_a_hole(spark, cfg):
    rows = [hour_row(0, oat_f=20.0), hour_row(5, oat_f=50.0)]
    assert by_hour(clean.rate_of_change_filter(hourly(spark, rows), cfg), "oat_f")[5] is None


def test_ranges_are_inclusive_and_small_negative_heat_is_clamped(spark):
    rows = [
        hour_row(0, hp_kwh_th=-1.0, dist_kwh=25.0, dist_water_kg=2271.0),
        hour_row(1, hp_kwh_th=-1.01, dist_kwh=25.01, dist_water_kg=2271.5, zones=[zone(heatcall=1.2, avg_temp=90.5)]),
    ]
    out = clean.valid_range_filter(clean.clamp_small_negative_hp(hourly(spark, rows)))
    assert by_hour(out, "hp_kwh_th") == {0: 0.0, 1: None}
    assert by_hour(out, "dist_kwh") == {0: 25.0, 1: None}
    assert by_hour(out, "dist_water_kg") == {0: 2271.0, 1: None}
    assert by_hour(out, "n_out_of_range") == {0: 0, 1: 5}
    assert tuple(by_hour(out, "zones")[1][0]) == (1, 68.0, None, None)


def test_rolling_means_need_observed_hours(spark, cfg):
    rows = [hour_row(i, oat_f=None if i == 10 else float(i), dist_kwh=None if i == 20 else 2.0) for i in range(30)]
    out = audit(spark, cfg, rows)
    oat = by_hour(out, "OAT_avg_4h")
    # hour 10 is filled: means that start or end there are invalid, inner ones are fine
    assert oat[11] is None and oat[14] is None
    assert oat[12] == pytest.approx(9.5) and oat[13] == pytest.approx(10.5)
    assert oat[3] is None and oat[4] == pytest.approx(1.5)
    load = by_hour(out, "dist_kwh_avg_4h")
    assert [i for i in range(4, 30) if load[i] is None] == [21, 22, 23, 24]


def test_setpoint_change_looks_at_survivors_one_hour_apart(spark, cfg):
    sets = {i: 68.0 for i in range(30)}
    sets |= {10: 66.0}                 # change after a consecutive hour, and back at 11
    sets |= {20: 70.0, 21: 70.0}       # 20 itself is dropped by the boiler rule
    rows = [
        hour_row(i, zones=[zone(avg_set=sets[i], avg_temp=sets[i])], oil_boiler_pwr=51.0 if i == 20 else 50.0)
        for i in range(30)
    ]
    verdicts = by_hour(audit(spark, cfg, rows), "dropped_by")
    assert verdicts[10] == "setpoint_change" and verdicts[11] == "setpoint_change"
    assert verdicts[20] == "oil_boiler"
    assert verdicts[21] is None       # previous survivor is two hours back
    assert verdicts[22] == "setpoint_change"


def test_below_setpoint_and_broken_thermostat(spark, cfg):
    special = {
        8: zone(avg_temp=67.0),                            # exactly one degree below
        10: zone(avg_temp=71.0, heatcall=0.02),            # warm with a call
        12: zone(avg_temp=71.0, heatcall=0.01),            # call too small to count
    }
    rows = [hour_row(i, zones=[special.get(i, zone())]) for i in range(16)]
    verdicts = by_hour(audit(spark, cfg, rows), "dropped_by")
    assert verdicts[8] == "below_setpoint"
    assert verdicts[10] == "broken_thermostat"
    assert verdicts[12] is None


def test_thermostat_gap_override_applies_to_one_zone_of_one_house(spark, cfg):
    warm = [zone(1), zone(2, avg_temp=72.0)]
    rows = [hour_row(i, house=h, zones=warm) for h in ("beech", "other") for i in range(8)]
    out = audit(spark, cfg, rows)
    assert by_hour(out, "dropped_by", "beech")[6] is None
    assert by_hour(out, "dropped_by", "other")[6] == "broken_thermostat"
    warmer = [hour_row(i, house="beech", zones=[zone(1), zone(2, avg_temp=72.5)]) for i in range(8)]
    assert by_hour(audit(spark, cfg, warmer), "dropped_by", "beech")[6] == "broken_thermostat"


def test_external_heat_is_flagged_but_only_dropped_on_request(spark, cfg):
    hot = [zone(1, avg_temp=71.0, heatcall=0.0), zone(2, avg_temp=70.0, heatcall=0.0)]
    shared = [zone(1, avg_temp=71.0, heatcall=0.0), zone(2, avg_temp=71.5, heatcall=0.4, avg_set=71.5)]
    rows = [hour_row(i, zones=hot if i == 6 else shared) for i in range(8)]
    out = audit(spark, cfg, rows)
    assert by_hour(out, "external_heat")[6] and not by_hour(out, "external_heat")[7]
    rows = [hour_row(i, zones=hot) for i in range(8)]
    assert by_hour(audit(spark, cfg, rows), "dropped_by")[6] is None
    strict = cfg.with_(drop_external_heat=True)
    assert by_hour(audit(spark, strict, rows), "dropped_by")[6] == "external_heat"


def test_houses_with_different_zones_do_not_affect_each_other(spark, cfg):
    one = [hour_row(i, house="a") for i in range(12)]
    three = [hour_row(i, house="b", zones=[zone(k) for k in (1, 2, 3)]) for i in range(12)]
    alone = by_hour(audit(spark, cfg, one), "dropped_by", "a")
    both = audit(spark, cfg, one + three)
    assert by_hour(both, "dropped_by", "a") == alone
    assert {len(z) for z in by_hour(both, "zones", "a").values()} == {1}
    assert {len(z) for z in by_hour(both, "zones", "b").values()} == {3}


def test_zone_missing_in_an_hour_counts_as_null(spark, cfg):
    rows = [hour_row(i, zones=[zone(1)] if 8 <= i < 12 else [zone(1), zone(2)]) for i in range(20)]
    out = audit(spark, cfg, rows)
    assert {i for i, g in by_hour(out, "gap_hour").items() if g} == {8, 9, 10, 11}


def test_optional_channels_are_never_required(spark, cfg):
    rows = [hour_row(i, swt_average_f=None, rwt_average_f=None, dist_water_kg=None) for i in range(12)]
    assert clean.cleaned_rows(audit(spark, cfg, rows)).count() == 8


def test_report_adds_up(spark, cfg):
    rows = [hour_row(i, oil_boiler_pwr=99.0 if i == 9 else 0.0, ws_mph=300.0 if i == 10 else 5.0)
            for i in range(24) if i != 15]
    report = clean.cleaning_report(audit(spark, cfg, rows)).first().asDict()
    dropped = sum(v for k, v in report.items() if k.startswith("dropped_"))
    assert report["grid_hours"] == 24 == dropped + report["kept_hours"]
    assert report["inserted_hours"] == 1 and report["nulled_range"] == 1
    assert report["dropped_oil_boiler"] == 1
    # the out-of-range wind, and nine channels of the inserted hour
    assert report["filled_values"] == 10


def test_row_order_does_not_matter(spark, cfg):
    rows = [hour_row(i, ws_mph=None if i % 7 == 0 else float(i)) for i in range(30)]
    key = lambda r: r["hour_start"]
    first = sorted(audit(spark, cfg, rows).collect(), key=key)
    second = sorted(audit(spark, cfg, rows[::-1]).collect(), key=key)
    assert first == second


def test_distribution_summary(spark, cfg):
    rows = [hour_row(i, ws_mph=v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, None])]
    frame = hourly(spark, rows)
    out = {(r["stage"], r["channel"]): r for r in clean.channel_distribution(frame, frame).collect()}
    wind = out["before", "ws_mph"]
    assert (wind["n_null"], wind["n_values"], wind["q1"], wind["median"], wind["q3"]) == (1, 5, 2.0, 3.0, 4.0)
    assert (wind["whisker_low"], wind["whisker_high"], wind["n_outliers"]) == (1.0, 4.0, 1)
    assert not any("heatcall" in channel for _, channel in out)
    after = out["after", "zone1_avg_set"]
    assert (after["axis_low"], after["axis_high"]) == (67.75, 68.25)
