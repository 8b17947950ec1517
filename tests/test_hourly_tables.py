from datetime import datetime, timedelta

from heat_rows import T0, by_hour, hour_row, hourly, zone
from pyspark.sql import functions as F

from hearthline.operators import columns, merge
from hearthline.plans import pipeline
from hearthline.sources import readers, writers


def test_fetched_rows_replace_cached_ones_and_repeating_changes_nothing(spark):
    cached = hourly(spark, [hour_row(i, dist_kwh=1.0) for i in range(10)])
    fetched = hourly(spark, [hour_row(i, dist_kwh=2.0, zones=[zone(3)]) for i in range(5, 15)])
    once = pipeline.update_cache(cached, fetched)
    assert by_hour(once, "dist_kwh") == {i: 1.0 if i < 5 else 2.0 for i in range(15)}
    twice = pipeline.update_cache(once, fetched)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    zones = columns.discover_zones(once).first().zone_list
    assert zones == [1, 3] == merge.zone_union(cached, fetched).first().zone_list


def test_missing_hours_become_half_open_ranges(spark):
    houses = spark.createDataFrame([("h1",), ("h2",)], "house_alias string")
    expected = merge.expected_hours(houses, T0, T0 + timedelta(hours=10))
    present = hourly(spark, [hour_row(i) for i in (0, 1, 4, 9)])
    ranges = merge.fetch_ranges(merge.missing_hours(expected, present)).collect()
    got = sorted((r.house_alias, (r.range_start - T0).seconds // 3600, (r.range_end - T0).seconds // 3600) for r in ranges)
    assert got == [("h1", 2, 4), ("h1", 5, 9), ("h2", 0, 10)]


def test_solar_lookup_fills_only_nulls(spark):
    rows = [hour_row(0, solar_w_m2=None), hour_row(1, solar_w_m2=5.0), hour_row(2, solar_w_m2=None)]
    solar = spark.createDataFrame([(T0, 7.0), (T0 + timedelta(hours=1), 8.0)], "hour_start timestamp_ntz, solar_w_m2 double")
    assert by_hour(merge.solar_fill(hourly(spark, rows), solar), "solar_w_m2") == {0: 7.0, 1: 5.0, 2: None}
    no_file = hourly(spark, rows + [hour_row(0, house="dark", solar_w_m2=None)])
    out = merge.solar_fill(no_file, None)
    assert by_hour(out, "solar_w_m2") == {0: None, 1: 5.0, 2: None}
    assert by_hour(out, "solar_w_m2", "dark") == {0: 0.0}


def test_hourly_table_round_trips(spark, tmp_path):
    rows = [hour_row(i, house=h, oat_f_forecast=[1.0, None, 3.5], ws_mph_forecast=[2.0]) for h in ("a", "b") for i in range(5)]
    frame = hourly(spark, rows)
    writers.write_hourly(frame, str(tmp_path / "t"))
    back = readers.scan_hourly_cache(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_wide_csv_round_trips_and_is_sorted_with_blanks(spark, tmp_path):
    rows = [hour_row(i, house=h, dist_water_kg=None, oat_f_forecast=[1.0, None], ws_mph_forecast=[2.0, 2.5],
                     zones=[zone(1), zone(2, heatcall=None)]) for h in ("a", "b") for i in (2, 0, 1)]
    frame = hourly(spark, rows)
    writers.write_hourly_csv(frame, str(tmp_path / "c"), zones=[1, 2])
    files = list((tmp_path / "c" / "house_alias=a").glob("*.csv"))
    text = [line for f in files for line in f.read_text().splitlines()]
    assert text[0].split(",")[-4:] == ["zone1_avg_set", "zone1_avg_temp", "zone2_avg_set", "zone2_avg_temp"]
    assert [line[:19] for line in text[1:]] == ["2024-01-01T00:00:00", "2024-01-01T01:00:00", "2024-01-01T02:00:00"]
    back = readers.scan_hourly_csv(spark, str(tmp_path / "c"))
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_houses_with_different_zones_survive_the_csv(spark, tmp_path):
    rows = [hour_row(i, house=h, zones=[zone(k) for k in zones]) for h, zones in (("one", (1,)), ("two", (1, 2))) for i in range(4)]
    frame = hourly(spark, rows)
    writers.write_hourly_csv(frame, str(tmp_path / "c"))
    back = readers.scan_hourly_csv(spark, str(tmp_path / "c"))
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_each_csv_file_is_read_by_its_own_header(spark, tmp_path):
    for house, text in (("a", "hour_start,oat_f,zone1_avg_set,zone1_avg_temp\n2024-01-01 00:00:00,1,68,67\n"),
                        ("b", "hour_start,zone3_avg_temp,oat_f,zone3_avg_set\n2024-01-01 00:00:00,60,2,\n")):
        (tmp_path / f"house_alias={house}").mkdir()
        (tmp_path / f"house_alias={house}" / "x.csv").write_text(text)
    out = {r.house_alias: r for r in readers.scan_hourly_csv(spark, str(tmp_path)).collect()}
    assert tuple(out["a"].zones[0]) == (1, 68.0, 67.0, None) and out["a"].oat_f == 1.0
    assert tuple(out["b"].zones[0]) == (3, None, 60.0, None) and out["b"].oat_f == 2.0


def test_csv_of_one_house_with_odd_columns(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(
        "hour_start,oat_f,note,zone2_avg_set,zone2_avg_temp,oat_f_forecast\n"
        '2024-01-01 00:00:00,NaN,hi,68,67.5,"[1.5, null]"\n2024-01-01 01:00:00,3,,,,\n')
    out = readers.scan_hourly_csv(spark, str(path), house="h9").orderBy("hour_start").collect()
    assert out[0].house_alias == "h9" and out[0].oat_f is None and out[0].dist_kwh is None
    assert tuple(out[0].zones[0]) == (2, 68.0, 67.5, None)
    assert out[0].oat_f_forecast == [1.5, None] and out[1].oat_f_forecast is None
    assert out[1].hour_start == datetime(2024, 1, 1, 1)


def test_solar_csv_reads_two_columns(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("hour_start,cloud,solar_w_m2\n2024-01-01 12:00:00,9,350.5\n2024-01-01 13:00:00,9,\n")
    out = readers.scan_solar(spark, str(path))
    assert [(r.hour_start.hour, r.solar_w_m2) for r in out.orderBy("hour_start").collect()] == [(12, 350.5), (13, None)]


def test_manifest_appends_houses_and_writes_open_bounds_as_inf(spark, cfg, tmp_path):
    for house in ("a", "b", "a"):
        houses = spark.createDataFrame([(house,)], "house_alias string")
        manifest = writers.run_manifest(houses, T0, T0 + timedelta(days=1), 123, cfg)
        writers.write_run_manifest(manifest, str(tmp_path / "m"))
    back = spark.read.json(str(tmp_path / "m")).orderBy("house_alias").collect()
    assert [r.energy_params_dir for r in back] == [f"results/result_123/{h}/energy_params" for h in "ab"]
    assert '"inf"' in back[0].parameters and '"thermostat_gap_overrides": [["beech", 2, 4.5]]' in back[0].parameters


def test_house_matching(spark):
    frame = spark.createDataFrame([(" Oak",), ("oakland",), ("fir",)], "a string")
    row = lambda **kw: [r[0] for r in frame.select(readers.house_match(F.col("a"), "OAK", **kw)).collect()]
    assert row() == [True, False, False]
    assert row(substring=True) == [True, True, False]
