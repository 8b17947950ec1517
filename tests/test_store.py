"""The telemetry store: what its scans read, and the refresh of the hourly table from it."""

import json
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.operators import telemetry as T
from hearthline.plans import pipeline, refresh
from hearthline.sources import readers
from hearthline.sources.store import Telemetry, open_store, write_store

START, END = datetime(2024, 1, 31), datetime(2024, 2, 2)


def raw(spark, houses=("h1", "House-7 ", "house-70"), hours=48):
    """Bursts inside hours, sensors, and a message every 12 hours, for each house."""
    since = datetime(2024, 1, 31, 5)
    seconds, readings, channels, messages = [], [], [], []
    for number, house in enumerate(houses):
        channels += [(10 * number, "zone1-x-temp", "AirTempFTimes1000", house), (10 * number + 1, "oil-boiler-pwr", "PowerW", house)]
        for hour in range(hours):
            at = since + timedelta(hours=hour)
            for second in range(600, 645):
                ts = at + timedelta(seconds=second)
                for channel, unit, value in (("dist-flow", "GpmTimes100", 100.0 + hour), ("dist-swt", "WaterTempCTimes1000", 45000.0 + 10 * second),
                                             ("dist-rwt", "WaterTempCTimes1000", 40000.0 + number), ("hp-lwt", "WaterTempCTimes1000", 50000.0)):
                    seconds.append((house, ts, channel, unit, value))
            readings += [(10 * number, at + timedelta(minutes=m), 68000.0 + m + hour) for m in (3, 20, 50)]
            readings += [(10 * number + 1, at + timedelta(minutes=m), float(m)) for m in (10, 30)]
            if hour % 12 == 0:
                payload = {"Time": ["a"] * 48, "OatF": [20.0 + hour + i for i in range(48)], "WindSpeedMph": [float(number)] * 48}
                messages.append((at - timedelta(minutes=1), "weather.forecast", house, json.dumps(payload)))
    readings.append((999, since, 1.0))  # of no listed channel
    return Telemetry(
        spark.createDataFrame(seconds, schemas.READINGS_1S), spark.createDataFrame(readings, schemas.READINGS),
        spark.createDataFrame(channels, schemas.READING_CHANNELS), spark.createDataFrame(messages, schemas.MESSAGES),
    )


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    """Plans print their paths and filters in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fleet") / "store")
    write_store(raw(spark, [f"h{k}" for k in range(50)], hours=4), path, buckets=256)
    return open_store(spark, path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small") / "store")
    plain = raw(spark)
    write_store(plain, path, buckets=16)
    return plain, open_store(spark, path)


def scans(telemetry, houses, cfg):
    since, until = datetime(2024, 1, 31, 5), datetime(2024, 2, 1, 5)
    return {
        "readings_1s": readers.scan_readings_1s(telemetry.readings_1s, since, until, T.CHANNELS_READ, houses),
        "readings": readers.scan_readings_with_channels(telemetry.readings, telemetry.channels, since, until, houses),
        "messages": readers.scan_forecast_messages(telemetry.messages, since, until, cfg, houses),
    }


def scan_nodes(plan):
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName() == "ReusedExchangeExec" or "QueryStage" in node.getClass().getSimpleName():
            return walk(node.plan() if "QueryStage" in node.getClass().getSimpleName() else node.child())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node)
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return found


def bytes_read(df, table):
    """Size of the files that the scan of a table opened."""
    df.collect()
    nodes = [n for n in scan_nodes(df._jdf.queryExecution().executedPlan()) if f"/store/{table}]" in n.toString()]
    assert nodes
    return sum(n.metrics().apply("filesSize").value() for n in nodes)


def test_one_of_fifty_houses_reads_its_share(spark, cfg, fleet, tmp_path):
    spark.createDataFrame([("H17",)], "house_alias string").write.parquet(str(tmp_path / "houses"))
    table = spark.read.parquet(str(tmp_path / "houses"))
    whole = {name: bytes_read(df, name) for name, df in scans(fleet, None, cfg).items()}
    for houses in (["H17 "], table):
        some = scans(fleet, houses, cfg)
        for name in whole:
            share = bytes_read(some[name], name) / whole[name]
            assert {r.house_alias for r in some[name].collect()} == {"h17"}
            assert share <= 0.04, (name, share)  # 1/50, or the double if another house has the bucket


def test_partition_filters_stand_in_the_plans(spark, cfg, fleet, tmp_path):
    spark.createDataFrame([("h3",)], "house_alias string").write.parquet(str(tmp_path / "houses"))
    for name, df in scans(fleet, spark.read.parquet(str(tmp_path / "houses")), cfg).items():
        line = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if f"/store/{name}]" in x)
        part = line.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
        assert "dynamicpruning" in part and "bucket" in part and "day" in part, part
    for name, df in scans(fleet, ["h3", "h4"], cfg).items():
        line = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if f"/store/{name}]" in x)
        if name != "readings":  # its houses are those of the channels, found when it runs
            assert "bucket" in line.split("PartitionFilters: [")[1].split("]")[0]
            assert "In(" in line.split("PushedFilters: [")[1].split("]")[0]


def test_store_and_plain_tables_give_the_same_hours(spark, cfg, small):
    plain, stored = small
    houses = spark.createDataFrame([("H1",), ("house-7",)], "house_alias string")
    for substring in (False, True):
        a, b = (sorted(pipeline.build_hourly(*t[:4], houses, START, END, cfg, substring, t.aliases).collect(), key=str) for t in (plain, stored))
        assert len(a) == 2 * 48 and a == b


def test_substring_owners_by_triples(spark):
    aliases = spark.createDataFrame([(x,) for x in ("h1.scada", "H1", "house-7", "House-70 ", "other", None, "ab")], "house_alias string")
    houses = spark.createDataFrame([(x,) for x in ("h1", "house-7", "absent", "b", "", None, "se-7")], "house_alias string")
    df = readers.owners(aliases, houses)
    assert {tuple(r) for r in df.collect()} == {
        ("h1.scada", "h1"), ("h1", "h1"), ("house-7", "house-7"), ("house-70", "house-7"), ("ab", "b"), ("house-7", "se-7"), ("house-70", "se-7")}
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_substring_scans_search_the_dictionary(spark, cfg, small):
    _, stored = small
    houses = spark.createDataFrame([("7",)], "house_alias string")
    since, until = datetime(2024, 1, 31, 5), datetime(2024, 2, 1, 5)
    df = readers.scan_readings_1s(stored.readings_1s, since, until, T.CHANNELS_READ, houses, True, stored.aliases)
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "NestedLoop" not in text and text.count("/store/readings_1s]") == 1
    assert df.count() == 2 * 24 * 45 * 4 and {r[0] for r in df.select("house_alias").distinct().collect()} == {"7"}


def files(path):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted(df.collect(), key=str)


def held(spark, cache, houses):
    return rows(refresh.read_hourly(spark, cache, houses, START, END))


def test_refresh_fills_holes_and_then_changes_nothing(spark, cfg, small, tmp_path):
    _, stored = small
    cache = str(tmp_path / "hourly")
    houses = spark.createDataFrame([("h1",), ("House-7",), ("unheard of",)], "house_alias string")
    full = rows(pipeline.build_hourly(*stored[:4], houses, START, END, cfg))
    first = refresh.refresh_hourly(spark, cache, stored, houses, START, END, cfg, buckets=4)
    assert first.ranges == 3 and first.hours == 3 * 48 and held(spark, cache, houses) == full

    # holes in both months, of one house most of a day and of the other single hours
    hour = F.col("hour_start")
    hole = (F.col("house_alias") == "h1") & (F.to_date(hour) == "2024-01-31") & (F.hour(hour) > 0) | (F.col("house_alias") == "house-7") & F.hour(hour).isin(5, 6, 20)
    refresh.writers.replace_partitions(refresh.open_hourly(spark, cache).where(~hole).persist(), cache, ["bucket", "month"], ["hour_start"])
    spark.catalog.clearCache()
    second = refresh.refresh_hourly(spark, cache, stored, houses, START, END, cfg)
    assert second.ranges == 1 + 2 * 2 and second.hours == 23 + 2 * 3
    assert held(spark, cache, houses) == full

    before = files(cache)
    assert refresh.refresh_hourly(spark, cache, stored, houses, START, END, cfg) == (0, 0, 0) and files(cache) == before


def test_a_failed_refresh_leaves_the_table(spark, cfg, small, tmp_path):
    _, stored = small
    cache = str(tmp_path / "hourly")
    houses = spark.createDataFrame([("h1",)], "house_alias string")
    refresh.refresh_hourly(spark, cache, stored, houses, START, START + timedelta(days=1), cfg)
    before = files(cache)
    broken = stored._replace(readings_1s=stored.readings_1s.withColumn(
        "value", F.when(F.col("ts") > datetime(2024, 2, 1, 12), F.raise_error(F.lit("broken disk")).cast("double")).otherwise(F.col("value"))))
    with pytest.raises(Exception, match="broken disk"):
        refresh.refresh_hourly(spark, cache, broken, houses, START, END, cfg)
    assert files(cache) == before
    refresh.refresh_hourly(spark, cache, stored, houses, START, END, cfg)
    changed = {p.parent.name for p in set(files(cache).items()) - set(before.items()) for p in [p[0]]}
    assert changed == {"month=202402"}  # January had no hole


def test_forced_refresh_keeps_nothing_else_of_its_houses(spark, cfg, small, tmp_path):
    _, stored = small
    cache = str(tmp_path / "hourly")
    houses = spark.createDataFrame([("h1",), ("house-7",)], "house_alias string")
    refresh.refresh_hourly(spark, cache, stored, houses, START, END, cfg, buckets=4)
    one = houses.limit(1)
    out = refresh.refresh_hourly(spark, cache, stored, one, datetime(2024, 2, 1), datetime(2024, 2, 2), cfg, force=True)
    assert out.hours == 24
    kept = refresh.open_hourly(spark, cache).groupBy("house_alias").agg(F.count("*"), F.min("hour_start")).collect()
    assert {tuple(r) for r in kept} == {("h1", 24, datetime(2024, 2, 1)), ("house-7", 48, START)}


def test_only_touched_partitions_and_days_are_read(spark, cfg, small, tmp_path):
    _, stored = small
    ranges = spark.createDataFrame([("h1", datetime(2024, 2, 1, 3), datetime(2024, 2, 1, 5))], "house_alias string, range_start timestamp_ntz, range_end timestamp_ntz")
    ranges.write.parquet(str(tmp_path / "ranges"))
    fetched = refresh.fetch_hours(stored, spark.read.parquet(str(tmp_path / "ranges")), cfg)
    assert [r.hour_start.hour for r in fetched.orderBy("hour_start").collect()] == [3, 4]
    text = fetched._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    for name in ("readings_1s", "readings", "messages"):
        line = next(x for x in text.splitlines() if f"/store/{name}]" in x)
        part = line.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
        days = {"2024-01-30", "2024-01-31", "2024-02-01"} if name == "messages" else {"2024-02-01"}  # the look-back is two days
        assert "dynamicpruning" in part and days == set(re.findall(r"2024-\d\d-\d\d", part)), (name, part)
